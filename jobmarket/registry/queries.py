"""One query per operator of the engine, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import jobmarket as jm
from jobmarket.functions import html as H
from jobmarket.functions import salary as S
from jobmarket.functions import text as X
from jobmarket.functions.industry import derived_industry
from jobmarket.functions.titles import clean_title, standardize_titles, taxonomy_match, uncategorized_titles
from jobmarket.operators.dedup import keep_first, keep_latest
from jobmarket.operators.upsert import upsert_jobs
from jobmarket.plans.explorer import list_jobs_after
from jobmarket.registry import tables as T
from jobmarket.schemas import JOB_KEY, JOBS
from jobmarket.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SOME_FILTERS = jm.Filters(region="ASIA", employment_type="1-URGENT")
INDUSTRY_FILTER = jm.Filters(category="BUILDING", industry="Trade BUILDING")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines compare the same type."""
    return df.select(
        [F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n) for n, t in df.dtypes]
    )


def texts(df: DataFrame) -> DataFrame:
    """Dates and times as text as well."""
    formats = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss"}
    return doubles(df).select(
        [F.date_format(n, formats[t]).alias(n) if t in formats else F.col(n) for n, t in df.dtypes]
    )


# -------------------------------------------------------------------- analytics


@query
def summary(spark, sf):
    return jm.analytics_summary(T.jobs_view(spark, sf))


@query
def summary_filtered(spark, sf):
    return jm.analytics_summary(T.jobs_view(spark, sf), INDUSTRY_FILTER)


@query
def top_categories(spark, sf):
    return jm.get_categories(T.jobs_view(spark, sf), 10)


@query
def top_locations(spark, sf):
    return jm.get_locations(T.jobs_view(spark, sf), 10, SOME_FILTERS)


@query
def regions(spark, sf):
    return jm.get_regions(T.jobs_view(spark, sf))


@query
def top_companies(spark, sf):
    return jm.get_companies(T.jobs_view(spark, sf), 10)


@query
def top_titles(spark, sf):
    return jm.get_job_titles(T.jobs_view(spark, sf), 20)


@query
def industries(spark, sf):
    return jm.get_industries(T.jobs_view(spark, sf), 20)


@query
def document_industries(spark, sf):
    docs = T.table(spark, sf, "documents").select(
        F.col("source").alias("job_title"), F.col("text").alias("description"),
        F.when(F.col("lang") == "de", "  ").otherwise(F.lit(None)).alias("industry"),
    )
    rules = [("French", ["eaux", "oui", "elle "]), ("German", ["sch", "und "]), ("English", ["the ", "tion"])]
    named = docs.select(derived_industry(rules=rules).alias("industry"))
    return named.groupBy("industry").agg(F.count("*").alias("job_count"))


@query
def employment_types(spark, sf):
    return jm.get_employment_types(T.jobs_view(spark, sf))


@query
def salary_summary(spark, sf):
    return doubles(jm.get_salary_summary(T.jobs_view(spark, sf))).withColumn(
        "average_salary", F.round("average_salary", 2)
    )


@query
def salary_by_category(spark, sf):
    return doubles(jm.get_salary_by_category(T.jobs_view(spark, sf)))


@query
def salary_by_category_filtered(spark, sf):
    return doubles(jm.get_salary_by_category(T.jobs_view(spark, sf), 5, SOME_FILTERS))


@query
def salary_distribution(spark, sf):
    return jm.get_salary_distribution(T.jobs_view(spark, sf))


@query
def salary_range_by_category(spark, sf):
    return doubles(jm.get_salary_range_by_category(T.jobs_view(spark, sf)))


@query
def filter_options(spark, sf):
    return jm.get_filter_options(T.jobs_view(spark, sf))


@query
def filter_list_regions(spark, sf):
    return jm.filter_list(T.jobs_view(spark, sf), "regions")


@query
def disclosure_rate(spark, sf):
    return jm.disclosure_rate(jm.analytics_summary(T.jobs_view(spark, sf))).select("disclosure_rate")


@query
def employment_share(spark, sf):
    return jm.employment_share(jm.get_employment_types(T.jobs_view(spark, sf))).withColumn(
        "share", F.round("share", 6)
    )


@query
def currency_labels(spark, sf):
    customers = T.table(spark, sf, "customer")
    return customers.select("c_custkey", jm.currency_label("c_acctbal").alias("label"))


@query
def chart_salary_range(spark, sf):
    return doubles(jm.chart_data(jm.get_salary_range_by_category(T.jobs_view(spark, sf))))


@query
def chart_employment(spark, sf):
    return jm.chart_data(jm.get_employment_types(T.jobs_view(spark, sf)))


@query
def chart_top_categories(spark, sf):
    return jm.chart_data(jm.get_categories(T.jobs_view(spark, sf), 10)).limit(8)


@query
def dashboard_panels(spark, sf):
    """All panels of the dashboard, as one long table."""
    measures = ("job_count", "average_salary", "salary_min", "salary_max")
    long = None
    for name, panel in jm.dashboard(T.jobs_view(spark, sf)).items():
        if name in ("summary", "salary_summary"):  # one row: every column is a measure
            panel = panel.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("average_salary")) for c in panel.columns])).alias("m")).select("m.*")
            panel = panel.withColumn("average_salary", F.round("average_salary", 2))
        elif name == "filter_options":
            panel = panel.select(F.concat_ws("|", "facet", "value").alias("label"))
        given = [F.col(m) if m in panel.columns else F.lit(None) for m in measures]
        rows = panel.select(
            F.lit(name).alias("panel"), F.col(panel.columns[0]).alias("label"), given[0].cast("long").alias("job_count"),
            *[c.cast("double").alias(m) for m, c in zip(measures[1:], given[1:])],
        )
        long = rows if long is None else long.unionByName(rows)
    return long


@query
def dashboard_summary(spark, sf):
    panels = jm.dashboard(T.jobs_view(spark, sf), jm.Filters(region="ASIA"))
    return panels["summary"]


# --------------------------------------------------------------------- explorer


@query
def jobs_page(spark, sf):
    page = jm.list_jobs(T.jobs_view(spark, sf), jm.JobFilters(region="asi"), page=3, limit=25)
    return texts(page)


@query
def jobs_deep_page(spark, sf):
    """A page beyond a thousand rows."""
    return texts(jm.list_jobs(T.jobs_view(spark, sf), page=11, limit=100))


@query
def jobs_after(spark, sf):
    """A page from the middle of the list, by key."""
    jobs = T.jobs_view(spark, sf)
    middle = T.table(spark, sf, "orders").agg(F.expr("max(o_orderkey) div 2")).scalar()
    return texts(list_jobs_after(jobs, middle, jm.JobFilters(region="asi"), limit=25))


@query
def jobs_offset(spark, sf):
    page = jm.list_jobs(T.jobs_view(spark, sf), jm.JobFilters(search="WIDGET"), page=9, limit=30, offset=15)
    return jm.display_rows(page)


@query
def salary_labels(spark, sf):
    return jm.display_rows(T.jobs_view(spark, sf))


@query
def jobs_count(spark, sf):
    wanted = jm.JobFilters(career_category="build", location="nation_1", employment_type="_-h", industry="other")
    return jm.get_job_count(T.jobs_view(spark, sf), wanted)


@query
def jobs_search(spark, sf):
    found = jm.JobFilters(search="customer#%7").apply(T.jobs_view(spark, sf))
    return found.select("id", "job_title", "company")


@query
def page_numbers(spark, sf):
    return jm.page_window(jm.get_job_count(T.jobs_view(spark, sf), jm.JobFilters(search="bolt")), 2, 20)


@query
def explorer_options(spark, sf):
    categories, locations = jm.explorer_options(T.jobs_view(spark, sf))
    return categories.select(F.lit("category").alias("kind"), F.col("career_category").alias("label"), "job_count").unionByName(
        locations.select(F.lit("location").alias("kind"), F.col("location").alias("label"), "job_count")
    )


# --------------------------------------------------------- cleaning, text and urls


@query
def salary_parse(spark, sf):
    raw = T.raw_postings(spark, sf)
    parsed = S.parse_salary(raw, S.salary_source(raw))
    return parsed.select("posting_id", *S.PARSED)


@query
def salary_normalize(spark, sf):
    raw = T.raw_postings(spark, sf)
    done = S.normalize_salary(S.parse_salary(raw, S.salary_source(raw)))
    return doubles(
        done.select(
            "posting_id", "salary_amount", "salary_period_inferred", "salary_outlier", "salary_period_used",
            "salary_period_estimated", "salary_amount_monthly",
        )
    )


@query
def salary_statistics(spark, sf):
    raw = T.raw_postings(spark, sf)
    stats = jm.get_salary_statistics(S.parse_salary(raw, S.salary_source(raw)))
    return stats.select([F.round(c, 2).alias(c) if t == "double" else F.col(c) for c, t in stats.dtypes])


@query
def placeholder_null(spark, sf):
    raw = T.raw_postings(spark, sf)
    return raw.select(
        "posting_id",
        X.clean_placeholder("employment_type").alias("employment_type"),
        X.clean_placeholder("education_requirement").alias("education_requirement"),
    )


@query
def employer_coalesce(spark, sf):
    raw = T.raw_postings(spark, sf)
    return raw.select(
        "posting_id", X.first_employer("company", "employer", "organization", "employer_name").alias("company")
    )


@query
def type_preparation(spark, sf):
    raw = T.raw_postings(spark, sf)
    return texts(
        raw.select(
            "posting_id", X.parse_date("date_posted").alias("date_posted"),
            X.parse_timestamp("collected_at").alias("collected_at"),
            X.parse_date("job_title").alias("no_date"),
        )
    )


@query
def url_normalize(spark, sf):
    pages = T.table(spark, sf, "pages")
    return pages.select(
        "page_id", X.normalize_url("url").alias("url"),
        X.dedup_key("url", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("dedup_key"),
    )


@query
def url_dedup_first(spark, sf):
    key = X.dedup_key("job_url", "job_title", "employer", "location")
    raw = T.raw_postings(spark, sf).withColumn("dedup_key", key)
    return keep_first(raw, "dedup_key", ["posting_id"]).select("posting_id", "dedup_key")


@query
def dedup_latest(spark, sf):
    postings = T.repeat_postings(spark, sf)
    latest = keep_latest(postings, tie_break=("job_url",))
    return texts(latest.select(*JOB_KEY, "job_url", "collected_at"))


@query
def text_dedup(spark, sf):
    docs = T.table(spark, sf, "documents")
    nothing = F.lit(None).cast("string")
    keyed = docs.select("doc_id", X.dedup_key(nothing, F.col("lang"), nothing, F.col("text")).alias("dedup_key"))
    return keep_first(keyed, "dedup_key", ["doc_id"])


@query
def row_text_parse(spark, sf):
    raw = T.raw_postings(spark, sf).select(
        "posting_id",
        F.concat_ws(
            " | ", "job_title", "salary_text", "employer", "location", "education_requirement",
            "employment_type",
            F.when(F.col("posting_id") % 5 != 0, F.concat(F.lit("POSTED ON "), F.col("date_posted"))),
        ).alias("t"),
    )
    return raw.select("posting_id", X.parse_row_text("t").alias("p")).select("posting_id", "p.*")


@query
def conversation_rows(spark, sf):
    turns = T.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", X.parse_row_text(F.regexp_replace("text", r"[.\n]", "|")).alias("p")).select(
        "conv_id", "turn", "p.*"
    )


# ----------------------------------------------------------------- page extraction


@query
def link_extract(spark, sf):
    return H.extract_links(T.table(spark, sf, "pages"), "/", "https://jobs.example.com")


@query
def listing_extract(spark, sf):
    pages = T.table(spark, sf, "pages")
    return H.extract_listings(pages, "/", "https://jobs.example.com", page="page_id").select(
        "page", "pos", "job_title", "job_url", "raw_row_text"
    )


@query
def card_extract(spark, sf):
    pages = T.table(spark, sf, "pages")
    fields = {"job_title": "h1", "salary": "span.salary"}
    return H.extract_cards(pages, "article", fields, ("page_id", "url"))


@query
def detail_extract(spark, sf):
    pages = T.table(spark, sf, "pages")
    return H.extract_details(pages, {"job_title": "title", "employer": "footer", "salary_text": ".salary"}, "page_id")


# ---------------------------------------------------------------------- collection


@query
def anti_join_new(spark, sf):
    listings, seen = T.crawl_tables(spark, sf)
    return jm.only_unseen(listings, seen).select("page", "pos", "job_url")


@query
def crawl_cutoff(spark, sf):
    listings, seen = T.crawl_tables(spark, sf)
    return jm.collect_new(listings, seen).select("page", "pos", "job_url")


@query
def crawl_stop_page(spark, sf):
    listings, seen = T.crawl_tables(spark, sf)
    return jm.crawl_stop(listings, seen)


@query
def page_statistics(spark, sf):
    listings, seen = T.crawl_tables(spark, sf)
    return jm.page_statistics(listings, seen)


@query
def seen_union(spark, sf):
    listings, seen = T.crawl_tables(spark, sf)
    return jm.union_seen(seen, listings)


@query
def detail_merge(spark, sf):
    listings = T.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("job_url"),
        F.col("o_orderstatus").alias("job_title"), F.lit("none").alias("salary_text"),
    )
    details = T.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("job_url"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("salary_text"),
        F.col("c_name").alias("employer"),
    )
    return jm.merge_details(listings, details)


# ------------------------------------------------------------- titles and locations


@query
def title_clean(spark, sf):
    return T.raw_postings(spark, sf).select("posting_id", clean_title("job_title").alias("words"))


@query
def title_taxonomy(spark, sf):
    titled = standardize_titles(T.raw_postings(spark, sf))
    return titled.select("posting_id", "job_title", "career_category", "title_match_method")


@query
def title_rules(spark, sf):
    part = T.table(spark, sf, "part")
    rules = [("Cold", [r"\bcold\b", r"\bblue\b"]), ("Round", [r"\bring\b", "rod"])]
    return part.select("p_partkey", F.coalesce(taxonomy_match(part, "p_name", rules), F.lit("Uncategorized")).alias("category"))


@query
def title_fuzzy(spark, sf):
    """Misspelled and shortened titles, most of them scored."""
    misspelled = F.element_at(
        F.array(*[F.lit(t) for t in ("Accountnt", "Export/Import Officer", "Credit/Collection Specialist",
                                     "Operator", "Tax Specialist", "Softwre Enginer", "Salesladdy")]),
        (F.col("p_size") % 7 + 1).cast("int"),
    )
    part = T.table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_type") == "ECONOMY", misspelled)
        .otherwise(F.concat_ws(" ", misspelled, "p_name")).alias("job_title"),
    )
    return standardize_titles(part)


@query
def uncategorized_rank(spark, sf):
    return uncategorized_titles(standardize_titles(T.raw_postings(spark, sf)))


@query
def lookup_build(spark, sf):
    return jm.build_location_lookup(*T.place_tables(spark, sf), order="ord")


@query
def lookup_statistics(spark, sf):
    return jm.lookup_statistics(*T.place_tables(spark, sf), order="ord")


@query
def location_resolve(spark, sf):
    lookup = jm.build_location_lookup(*T.place_tables(spark, sf), order="ord")
    placed = jm.standardize_locations(T.raw_postings(spark, sf).select("posting_id", "location"), lookup)
    return placed.select("posting_id", "location", "region")


# --------------------------------------------------------- whole rows, report, upsert


def _clean(spark, sf) -> DataFrame:
    lookup = jm.build_location_lookup(*T.place_tables(spark, sf), order="ord")
    return jm.clean_records(T.raw_postings(spark, sf), lookup)


@query
def clean_rows(spark, sf):
    return texts(
        jm.prepare(keep_first(_clean(spark, sf), "dedup_key", ["posting_id"])).drop("industry", "description")
    )


@query
def quality_report(spark, sf):
    return jm.quality_report(_clean(spark, sf), ["posting_id"])


@query
def upsert_snapshot(spark, sf):
    """Two imports: earlier orders, then later ones overlapping them in keys."""
    postings = T.repeat_postings(spark, sf)
    stamp = F.lit("2026-01-01 00:00:00").cast("timestamp")
    later = F.lit("2026-02-02 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], JOBS)
    first = staged(upsert_jobs(empty, postings.where("date_posted < date'1998-01-01'"), stamp), "first")
    second = upsert_jobs(first, postings.where("date_posted >= date'1997-01-01'"), later)
    return texts(second.select("id", *JOB_KEY, "region", "salary_amount", "job_url", "collected_at", "created_at"))


@query
def import_counts(spark, sf):
    postings = T.repeat_postings(spark, sf)
    before = keep_latest(postings.where("date_posted < date'1998-01-01'"))
    return jm.import_statistics(before, keep_latest(postings))
