"""Job postings derived from the star-schema tables.

Every order becomes one posting: its customer is the employer, the customer's nation
and a numbered town give the location, and texts come in all the forms the cleaners
handle.  ``registry/sql.py`` states the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(number: str, *choices: str, default: str = "NULL") -> str:
    """The choice whose position equals ``number``."""
    branches = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices))
    return f"CASE {number} {branches} ELSE {default} END"


def _orders(spark: SparkSession, sf_dir: str, status: bool = False) -> DataFrame:
    """Orders with what belongs to them; with ``status`` joined by key to the statuses of all orders, as ``_status``."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    parts = part.agg(F.count("*")).scalar()
    # titles and salaries cost far more per row than this shuffle; a number, or few rows would end in one task
    orders = table(spark, sf_dir, "orders").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    if status:
        statuses = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS _key", "o_orderstatus AS _status")
        orders = orders.join(statuses, F.col("o_orderkey") == F.col("_key"))
    return (
        orders
        .withColumn("p_partkey", F.col("o_orderkey") % parts)
        .join(part, "p_partkey")
        .join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .selectExpr(
            "*",
            "o_orderkey AS k",
            "CAST(floor(o_totalprice) AS BIGINT) AS whole",
            "'Town ' || (o_orderkey % 60) AS town",
        )
    )


TITLE = _choose(
    "k % 16",
    "p_name",
    "'Senior Data Analyst'",
    "'SALES ASSOCIATE - ' || p_name",
    "'Software Engineer (' || p_name || ')'",
    "'Jr. Accountant'",
    "'Help Desk / ' || p_name",
    "'Store Manager & Cashier'",
    "'nurse ' || p_name",
    "' Warehouse helper '",
    "' '",
    "NULL",
    "'Agriculturist ' || p_name",
    "'Production Machine Operator'",
    "'Teacher, ' || p_name",
    "'principal'",
    "upper(p_name)",
)

SALARY_TEXT = _choose(
    "k % 12",
    "'Salary not specified'",
    "'P' || (whole div 500)",
    "string(whole div 100)",
    "'P' || (whole div 1000) || ',' || lpad(string(whole % 1000), 3, '0') || '/year'",
    "(whole div 10000 + 1) || 'k monthly'",
    "'P' || (whole div 20) || ' - P' || (whole div 10)",
    "(whole div 5000 + 1) || '-' || (whole div 2500 + 2) || 'k'",
    "'0'",
    "'USD ' || (whole div 1000 + 1) || ' per week'",
    "(whole div 100) || ' to ' || (whole div 50) || ' + 13th month pay'",
    "'Competitive salary'",
)

LOCATION = _choose(
    "k % 12",
    "'City Of ' || town || ', ' || n_name",
    "town",
    "n_name",
    "'Barangay 5, ' || town || ' City, ' || n_name",
    "'City Of ' || n_name || ', Ncr, Fourth District'",
    "'Work from home'",
    "'EUROPE'",
    "'taiwan, r.o.c.'",
    "'Nowhere ' || (k % 7)",
    "''",
    "NULL",
    "upper(town || ' (capital), ' || n_name)",
)


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as collectors deliver them, with ``posting_id`` as load order."""
    columns = {
        "posting_id": "k",
        "job_title": TITLE,
        "salary_text": SALARY_TEXT,
        "salary": "CASE WHEN k % 12 = 11 THEN '900' END",
        "company": "CASE WHEN k % 23 = 0 THEN '  ' WHEN k % 23 = 1 THEN '' END",
        "employer": "CASE WHEN k % 29 <> 0 THEN c_name ELSE '' END",
        "organization": "CASE WHEN k % 31 <> 0 THEN c_name || ' Group' END",
        "employer_name": "CAST(NULL AS STRING)",
        "location": LOCATION,
        "employment_type": "o_orderpriority",
        "education_requirement": "CASE WHEN k % 9 = 0 THEN 'Educ level not specified' ELSE p_type END",
        "date_posted": "date_format(o_orderdate, 'M/d/yyyy')",
        "industry": "CAST(NULL AS STRING)",
        "description": "CAST(NULL AS STRING)",
        "job_url": "CASE WHEN k % 10 = 0 THEN '' ELSE 'https://jobs.example.com/' || (k div 3)"
        " || CASE WHEN k % 3 = 0 THEN '/?utm=1#t' ELSE '' END END",
        "source": "'orders'",
        "collected_at": "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\")",
    }
    return _orders(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def jobs_view(spark: SparkSession, sf_dir: str, status: bool = False) -> DataFrame:
    """Postings as the jobs table holds them, with blanks and nulls in every label."""
    shown, period = "k % 4 <> 0", "k % 11 <> 0"
    columns = {
        "id": "k + 1",
        "job_title": TITLE,
        "career_category": _choose("k % 37", "NULL", "''", "' '", default="c_mktsegment"),
        "title_match_method": "'exact'",
        "company": _choose("k % 41", "''", "NULL", default="c_name"),
        "location": _choose("k % 43", "NULL", "' '", default="n_name"),
        "region": _choose("k % 47", "NULL", default="r_name"),
        "salary_amount": f"CASE WHEN {shown} THEN CAST(floor(o_totalprice * 4) / 4 AS DECIMAL(18,2)) END",
        "salary_period": _choose("k % 6", "'monthly'", "''"),
        "salary_period_inferred": "CAST(NULL AS STRING)",
        "salary_amount_monthly": f"CASE WHEN {shown} AND {period} THEN CAST(floor(o_totalprice / 9) * "
        "CASE WHEN k % 7 = 0 THEN 3 ELSE 1 END AS DECIMAL(18,2)) END",
        "salary_period_used": f"CASE WHEN {period} THEN "
        + _choose("k % 5", "'daily'", "'weekly'", "'hourly'", "'monthly'", "'annual'")
        + " END",
        "salary_period_estimated": "k % 3 = 0",
        "salary_disclosed": shown,
        "currency": f"CASE WHEN {shown} THEN 'PHP' END",
        "date_posted": "to_date(o_orderdate)",
        "employment_type": "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END",
        "education_requirement": "p_type",
        "industry": _choose("k % 5", "'Trade ' || c_mktsegment", "''"),
        "description": _choose("k % 3", "'We need a driver for ' || p_name", "p_type"),
        "source": "'orders'",
        "job_url": "'https://jobs.example.com/' || k",
        "collected_at": "o_orderdate",
    }
    if status:
        columns["_status"] = "_status"
    return _orders(spark, sf_dir, status).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def repeat_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean postings with few distinct keys, so that an upsert meets many repeats."""
    # statuses meet the orders by their key before these become wide rows
    return (
        jobs_view(spark, sf_dir, status=True)
        .withColumn("job_title", F.col("_status"))
        .withColumn("career_category", F.coalesce("employment_type", F.lit("Uncategorized")))
        .drop("_status", "id")
    )


def place_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions, provinces, municipalities) with place codes: region, nation, supplier.

    Region 3 gets the code of the capital region, so its nations act as its cities.
    """
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")

    nation_code = "(10 + n_regionkey) || lpad(string(n_nationkey), 2, '0')"
    regions = region.selectExpr(
        "(10 + r_regionkey) || '0000000' AS code", "r_name AS description", "bigint(r_regionkey) AS ord"
    )
    provinces = nation.selectExpr(
        f"{nation_code} || '00000' AS code",
        "CASE WHEN n_regionkey = 3 THEN 'City of ' || n_name ELSE n_name END AS description",
        "bigint(n_nationkey) AS ord",
    )
    town = "'Town ' || (s_suppkey % 50)"
    name = _choose("s_suppkey % 4", f"'City Of ' || {town}", f"{town} || ' (Capital)'", f"{town} || ' City'", town)
    municipalities = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        f"CASE WHEN s_suppkey % 17 = 0 THEN '9999' ELSE {nation_code} END"
        " || lpad(string(s_suppkey % 100000), 5, '0') AS code",
        f"CASE WHEN s_suppkey % 13 = 5 THEN 'NATION_' || (s_suppkey % 25) ELSE {name} END AS description",
        "s_suppkey AS ord",
    )
    return regions, provinces, municipalities


def crawl_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(listings, seen): fifty events are one listing page, error events are history."""
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id div 50 AS page",
        "int(event_id % 50) AS pos",
        "'https://jobs.example.com/' || user_id || '/' || event_type AS job_url",
        "event_type",
    )
    seen = events.where("event_type = 'error'").select("job_url").distinct()
    return events, seen
