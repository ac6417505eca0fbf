"""All dashboard panels from one scan.

The filtered table is read once: each posting contributes to one group per facet, and
partial sums shrink that in the map tasks.  The panels are then small queries over
the resulting cube; only the unfiltered filter options read the table again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmarket.functions.industry import DERIVED, with_industry
from jobmarket.functions.salary import bucket_label, bucket_number
from jobmarket.functions.text import is_filled, label
from jobmarket.plans.analytics import (
    DEFAULT_LABELS,
    MONTHLY,
    _ranked,
    get_filter_options,
    rounded_average,
)
from jobmarket.plans.filters import NO_FILTERS, Filters, has_salary
from jobmarket.rules.taxonomy import UNCATEGORIZED
from jobmarket.sources.staging import staged

CUBE_FACETS = {
    "career_category": "career_category",
    "location": "location",
    "region": "region",
    "company": "company",
    "job_title": "job_title",
    "industry": DERIVED,
    "employment_type": "employment_type",
}


def panel_cube(jobs: DataFrame, filters: Filters = NO_FILTERS) -> DataFrame:
    """``(facet, value)`` with posting counts and salary sums."""
    jobs = filters.apply(with_industry(jobs))
    paid = F.coalesce(has_salary(), F.lit(False))
    bucket = F.when(paid, bucket_number(F.col(MONTHLY)).cast("string"))
    facets = [
        F.struct(F.lit(name).alias("facet"), F.col(column).alias("value"))
        for name, column in CUBE_FACETS.items()
    ]
    facets.append(F.struct(F.lit("salary_range").alias("facet"), bucket.alias("value")))
    exploded = jobs.select(
        F.when(paid, F.col(MONTHLY)).alias("_monthly"),
        "salary_disclosed",
        F.explode(F.array(*facets)).alias("_f"),
    ).select("_f.facet", "_f.value", "_monthly", "salary_disclosed")
    return exploded.groupBy("facet", "value").agg(
        F.count("*").alias("job_count"),
        F.count_if("salary_disclosed").alias("disclosed"),
        F.count("_monthly").alias("salary_count"),
        F.sum("_monthly").alias("salary_total"),
        F.min("_monthly").alias("salary_min"),
        F.max("_monthly").alias("salary_max"),
    )


def _counts(cube: DataFrame, facet: str, limit: int | None, filled: bool = False) -> DataFrame:
    rows = cube.where(F.col("facet") == facet)
    if filled:
        rows = rows.where(is_filled("value"))
    shown = label("value", DEFAULT_LABELS[facet]) if facet in DEFAULT_LABELS else F.col("value")
    return _ranked(rows.select(shown.alias(facet), "job_count"), facet, limit)


def _summary(cube: DataFrame) -> DataFrame:
    def distinct(facet: str):
        value = F.nullif(F.trim("value"), F.lit(""))
        return F.count_distinct(F.when(F.col("facet") == facet, value))

    every = F.col("facet") == "region"  # each posting is counted once per facet
    return cube.agg(
        F.coalesce(F.sum(F.when(every, F.col("job_count"))), F.lit(0)).alias("total_jobs"),
        distinct("company").alias("total_companies"),
        distinct("career_category").alias("total_categories"),
        distinct("location").alias("total_locations"),
        distinct("region").alias("total_regions"),
        F.coalesce(F.sum(F.when(every, F.col("disclosed"))), F.lit(0)).alias("jobs_with_salary"),
    )


def dashboard(
    jobs: DataFrame, filters: Filters = NO_FILTERS, limit: int = 10, cube: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All panels.  The cube is stored once in the shared folder unless you pass your own."""
    cube = staged(panel_cube(jobs, filters), "cube") if cube is None else cube
    paid = cube.where((F.col("facet") == "career_category") & (F.col("salary_count") > 0)).select(
        label("value", UNCATEGORIZED).alias("career_category"),
        "salary_min",
        "salary_max",
        rounded_average(F.col("salary_total"), F.col("salary_count")).alias("average_salary"),
        F.col("salary_count").alias("job_count"),
    )
    salary = cube.where(F.col("facet") == "region").agg(
        (F.sum("salary_total") / F.nullif(F.sum("salary_count"), F.lit(0))).alias("average_salary"),
        F.min("salary_min").alias("lowest_salary"),
        F.max("salary_max").alias("highest_salary"),
        F.coalesce(F.sum("salary_count"), F.lit(0)).alias("salary_job_count"),
    )
    buckets = cube.where((F.col("facet") == "salary_range") & F.col("value").isNotNull())
    number = F.col("value").cast("int")
    return {
        "summary": _summary(cube),
        "categories": _counts(cube, "career_category", limit),
        "locations": _counts(cube, "location", limit),
        "regions": _counts(cube, "region", None),
        "companies": _counts(cube, "company", limit, filled=True),
        "job_titles": _counts(cube, "job_title", limit, filled=True),
        "industries": _counts(cube, "industry", limit),
        "employment_types": _counts(cube, "employment_type", None),
        "salary_summary": salary,
        "salary_by_category": _ranked(
            paid.select("career_category", "average_salary", "job_count"), "career_category", limit
        ),
        "salary_distribution": buckets.orderBy(number).select(
            bucket_label(number).alias("salary_range"), "job_count"
        ),
        "salary_range_by_category": _ranked(paid, "career_category", limit),
        "filter_options": get_filter_options(jobs),  # never filtered
    }
