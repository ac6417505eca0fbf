"""Analytics over the jobs table; every function returns a lazy DataFrame.

Counts group by the stored value and label it afterwards, so null, empty and blank
values stay separate rows under one label.  Grouping happens with partial sums in
the map tasks; top-k lists end in a bounded take-ordered step, ties by label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.functions.industry import DERIVED, with_industry
from jobmarket.functions.salary import bucket_label, bucket_number
from jobmarket.functions.text import is_filled, label
from jobmarket.plans.filters import NO_FILTERS, Filters, checked_limit, has_salary
from jobmarket.rules.taxonomy import UNCATEGORIZED

MONTHLY = "salary_amount_monthly"

#: labels shown for blank values
DEFAULT_LABELS = {
    "career_category": UNCATEGORIZED,
    "location": "Unknown",
    "region": "Unknown",
    "employment_type": "Not specified",
}


def rounded_average(total: Column, count: Column) -> Column:
    """Average of positive amounts, rounded half up to a whole number, exactly."""
    return F.call_function("div", total * 2 + count, count * 2).cast("decimal(18,0)")


def _ranked(counted: DataFrame, name: str, limit: int | None) -> DataFrame:
    # groups under one label may tie in count too; the other columns then decide
    rest = [c for c in counted.columns if c not in (name, "job_count")]
    ordered = counted.orderBy(F.desc("job_count"), name, *rest)
    return ordered if limit is None else ordered.limit(checked_limit(limit))


def _jobs_per(
    jobs: DataFrame, column: str, limit: int | None, filters: Filters, filled: bool = False
) -> DataFrame:
    jobs = filters.apply(jobs)
    if filled:
        jobs = jobs.where(is_filled(column))
    counted = jobs.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("job_count"))
    shown = label("_value", DEFAULT_LABELS[column]) if column in DEFAULT_LABELS else F.col("_value")
    return _ranked(counted.select(shown.alias(column), "job_count"), column, limit)


def analytics_summary(jobs: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """Totals: postings, companies, categories, locations, regions, with salary."""

    def distinct(column: str) -> Column:
        return F.count_distinct(F.nullif(F.trim(column), F.lit("")))

    return filters.apply(jobs).agg(
        F.count("*").alias("total_jobs"),
        distinct("company").alias("total_companies"),
        distinct("career_category").alias("total_categories"),
        distinct("location").alias("total_locations"),
        distinct("region").alias("total_regions"),
        F.count_if("salary_disclosed").alias("jobs_with_salary"),
    )


def get_categories(jobs: DataFrame, limit: int = 10, filters: Filters = NO_FILTERS) -> DataFrame:
    return _jobs_per(jobs, "career_category", limit, filters)


def get_locations(jobs: DataFrame, limit: int = 10, filters: Filters = NO_FILTERS) -> DataFrame:
    return _jobs_per(jobs, "location", limit, filters)


def get_regions(jobs: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    return _jobs_per(jobs, "region", None, filters)


def get_companies(jobs: DataFrame, limit: int = 10, filters: Filters = NO_FILTERS) -> DataFrame:
    return _jobs_per(jobs, "company", limit, filters, filled=True)


def get_job_titles(jobs: DataFrame, limit: int = 10, filters: Filters = NO_FILTERS) -> DataFrame:
    return _jobs_per(jobs, "job_title", limit, filters, filled=True)


def get_industries(jobs: DataFrame, limit: int = 10, filters: Filters = NO_FILTERS) -> DataFrame:
    derived = filters.apply(with_industry(jobs))
    counted = derived.groupBy(F.col(DERIVED).alias("industry")).agg(F.count("*").alias("job_count"))
    return _ranked(counted, "industry", limit)


def get_employment_types(jobs: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    return _jobs_per(jobs, "employment_type", None, filters)


# --------------------------------------------------------------------- salaries


def get_salary_summary(jobs: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    return filters.apply(jobs).where(has_salary()).agg(
        F.avg(MONTHLY).alias("average_salary"),
        F.min(MONTHLY).alias("lowest_salary"),
        F.max(MONTHLY).alias("highest_salary"),
        F.count("*").alias("salary_job_count"),
    )


def _salary_per_category(jobs: DataFrame, filters: Filters) -> DataFrame:
    per_value = filters.apply(jobs).where(has_salary()).groupBy(F.col("career_category").alias("_value"))
    counted = per_value.agg(
        F.min(MONTHLY).alias("salary_min"),
        F.max(MONTHLY).alias("salary_max"),
        F.sum(MONTHLY).alias("_total"),
        F.count("*").alias("job_count"),
    )
    return counted.select(
        label("_value", UNCATEGORIZED).alias("career_category"),
        "salary_min",
        "salary_max",
        rounded_average(F.col("_total"), F.col("job_count")).alias("average_salary"),
        "job_count",
    )


def get_salary_by_category(
    jobs: DataFrame, limit: int = 10, filters: Filters = NO_FILTERS
) -> DataFrame:
    table = _salary_per_category(jobs, filters)
    return _ranked(
        table.select("career_category", "average_salary", "job_count"), "career_category", limit
    )


def get_salary_range_by_category(
    jobs: DataFrame, limit: int = 10, filters: Filters = NO_FILTERS
) -> DataFrame:
    return _ranked(_salary_per_category(jobs, filters), "career_category", limit)


def get_salary_distribution(jobs: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """Histogram in bucket order; empty buckets are absent."""
    numbered = filters.apply(jobs).where(has_salary()).select(bucket_number(F.col(MONTHLY)).alias("_b"))
    counted = numbered.groupBy("_b").agg(F.count("*").alias("job_count")).orderBy("_b")
    return counted.select(bucket_label(F.col("_b")).alias("salary_range"), "job_count")


def get_salary_statistics(parsed: DataFrame) -> DataFrame:
    """Older statistics over the minimum and maximum columns before they are merged."""
    # no filter: pushed below the parsing steps it would repeat all of them
    shown = F.col("salary_disclosed") & F.col("salary_min").isNotNull()
    low, high = F.when(shown, F.col("salary_min")), F.when(shown, F.col("salary_max"))
    return parsed.agg(
        F.count_if(shown).alias("jobs_with_salary"),
        F.avg(low).alias("average_salary_min"),
        F.avg(high).alias("average_salary_max"),
        F.min(low).alias("lowest_salary_min"),
        F.max(high).alias("highest_salary_max"),
    )


# ---------------------------------------------------------------- filter options

FACETS = {
    "categories": "career_category",
    "regions": "region",
    "industries": DERIVED,
    "employment_types": "employment_type",
}


def get_filter_options(jobs: DataFrame) -> DataFrame:
    """``(facet, value)``: sorted distinct non-blank values of all four lists, in one scan."""
    jobs = with_industry(jobs)
    pairs = F.array(
        *[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in FACETS.items()]
    )
    exploded = jobs.select(F.explode(pairs).alias("p")).select("p.facet", "p.value")
    return exploded.where(is_filled("value")).distinct().orderBy("facet", "value")


def filter_list(jobs: DataFrame, facet: str) -> DataFrame:
    """One of the four lists alone."""
    column = FACETS[facet]
    jobs = with_industry(jobs) if column == DERIVED else jobs
    return jobs.where(is_filled(column)).select(F.col(column).alias("value")).distinct().orderBy("value")


# ----------------------------------------------------------------- derived figures


def disclosure_rate(summary: DataFrame) -> DataFrame:
    """Share of postings with salary in percent, rounded half up; 0 without postings."""
    share = F.floor(F.col("jobs_with_salary") * 100.0 / F.col("total_jobs") + 0.5)
    return summary.withColumn(
        "disclosure_rate", F.when(F.col("total_jobs") > 0, share).otherwise(F.lit(0)).cast("bigint")
    )


def employment_share(employment_types: DataFrame) -> DataFrame:
    """Counts with their total and share; the input has one row per employment type."""
    whole = employment_types.agg(F.sum("job_count")).scalar()
    return employment_types.select(
        "employment_type", "job_count", whole.alias("total"), (F.col("job_count") / whole).alias("share")
    )


def currency_label(amount: Column | str) -> Column:
    """``₱`` and the rounded amount with thousands separators, else ``N/A``."""
    value = F.col(amount) if isinstance(amount, str) else amount
    whole = F.floor(value + F.lit(0.5)).cast("bigint")
    return F.when(
        (value > 0) & ~F.isnan(value.cast("double")), F.concat(F.lit("₱"), F.format_number(whole, 0))
    ).otherwise("N/A")


def chart_data(panel: DataFrame) -> DataFrame:
    """Chart shape of any panel: ``name`` plus ``jobs``, ``value`` or salary columns."""
    name = panel.columns[0]
    default = "Other" if name == "industry" else DEFAULT_LABELS.get(name, "Unknown")

    def number(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    if name == "employment_type":
        return panel.where(F.coalesce(name, F.lit("")) != "").select(
            F.col(name).alias("name"), number("job_count").alias("value")
        )
    shape = {"average_salary": "average", "salary_min": "minimum", "salary_max": "maximum"}
    shown = [number(c).alias(shape[c]) for c in panel.columns if c in shape]
    if "salary_min" not in panel.columns:
        shown.append(number("job_count").alias("jobs"))
    title = F.col(name) if name == "salary_range" else F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))
    return panel.select(title.alias("name"), *shown)
