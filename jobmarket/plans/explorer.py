"""Job listing: filters, paging, counts and display columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobmarket.functions.text import blank_to_null
from jobmarket.plans.analytics import get_categories, get_locations
from jobmarket.plans.filters import JobFilters
from jobmarket.rules.salary import PERIOD_LABELS
from jobmarket.schemas import LISTING_COLUMNS

DEFAULT_PAGE_SIZE = 20
LARGEST_PAGE = 100
#: an offset from which on the rows before it are counted instead of sorted
DEEP = 1000
#: ids that are counted together
ID_RANGE = 1 << 16


def safe_page(page) -> int:
    """Anything that is no finite number of at least 1 means the first page."""
    number = _finite(page)
    return math.floor(number) if number is not None and number >= 1 else 1


def safe_limit(limit) -> int:
    number = _finite(limit)
    if number is None or number < 1:
        return DEFAULT_PAGE_SIZE
    return min(math.floor(number), LARGEST_PAGE)


def _finite(value) -> float | None:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if math.isfinite(number) else None


def list_jobs(
    jobs: DataFrame,
    filters: JobFilters = JobFilters(),
    page: int = 1,
    limit: int = DEFAULT_PAGE_SIZE,
    offset: int | None = None,
) -> DataFrame:
    """Newest postings first; an explicit ``offset`` wins over ``page``.

    A limit above :data:`LARGEST_PAGE` is lowered to it, and anything that is no number of at
    least 1 means the default.  For a page deep in the list the wanted rows are counted per range of
    ids first, over the filters' columns only; then the rows of the ranges that hold the page are read and
    sorted, and none before them.  :func:`list_jobs_after` needs no count.
    """
    size = safe_limit(limit)
    start = (safe_page(page) - 1) * size if offset is None else max(0, offset)
    if start >= DEEP:
        return _deep_page(jobs, filters, start, size)
    wanted = filters.apply(jobs).select(*LISTING_COLUMNS)
    return wanted.orderBy(F.desc("id")).offset(start).limit(size)


def _deep_page(jobs: DataFrame, filters: JobFilters, start: int, size: int) -> DataFrame:
    """Rows ``start + 1`` to ``start + size`` of the list, from the ranges of ids that hold them."""
    counts = filters.apply(jobs).groupBy(F.expr(f"id div {ID_RANGE}").alias("part")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("part")))  # one row per range
    held = counts.select("part", (upto - F.col("n")).alias("before"), upto.alias("upto")).where((F.col("upto") > start) & (F.col("before") < start + size))
    ends = held.agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("before").alias("before"))
    low, high, before = (ends.select(c).scalar() for c in ("low", "high", "before"))
    near = filters.apply(jobs.where((F.col("id") >= low * ID_RANGE) & (F.col("id") < (high + 1) * ID_RANGE))).select(*LISTING_COLUMNS)
    place = F.row_number().over(Window.orderBy(F.desc("id"))) + before  # over the rows of these ranges
    return near.withColumn("_place", place).where((F.col("_place") > start) & (F.col("_place") <= start + size)).orderBy("_place").drop("_place")


def list_jobs_after(
    jobs: DataFrame, last_id: int | Column | None = None, filters: JobFilters = JobFilters(), limit: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """The page that follows the posting ``last_id`` (the first page without one), newest first.

    Every page costs the same: no rows before it are sorted or skipped, and the filter on id
    reaches the scan.
    """
    wanted = jobs if last_id is None else jobs.where(F.col("id") < last_id)
    return filters.apply(wanted).select(*LISTING_COLUMNS).orderBy(F.desc("id")).limit(safe_limit(limit))


def get_job_count(jobs: DataFrame, filters: JobFilters = JobFilters()) -> DataFrame:
    return filters.apply(jobs).agg(F.count("*").alias("count"))


def page_window(count: DataFrame, page: int = 1, limit: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """First and last row number of a page and the number of pages."""
    page, size = safe_page(page), safe_limit(limit)
    total = F.col("count")
    first = F.when(total == 0, 0).otherwise((page - 1) * size + 1)
    return count.select(
        "count",
        first.cast("bigint").alias("first_row"),
        F.least(F.lit(page * size), total).cast("bigint").alias("last_row"),
        F.greatest(F.lit(1), F.ceil(total / size)).cast("bigint").alias("total_pages"),
    )


def salary_label() -> Column:
    """``Not disclosed``, or amount, pay period and a mark for estimated periods."""
    period = F.coalesce(blank_to_null("salary_period_used"), F.col("salary_period"))
    unit = F.coalesce(*[F.when(period == p, F.lit(text)) for p, text in PERIOD_LABELS.items()])
    amount = F.concat(F.lit("₱"), F.call_function(
        "format_number", F.col("salary_amount"), F.lit("#,##0.###")
    ))
    return (
        F.when(~F.coalesce("salary_disclosed", F.lit(False)) | F.col("salary_amount").isNull(), "Not disclosed")
        .when(unit.isNull(), amount)
        .when(F.col("salary_period_estimated"), F.concat(amount, unit, F.lit(" (est.)")))
        .otherwise(F.concat(amount, unit))
    )


def display_rows(listing: DataFrame) -> DataFrame:
    """Table columns with the texts shown for missing values."""

    def shown(column: str, default: str) -> Column:
        return F.coalesce(blank_to_null(column), F.lit(default)).alias(column)

    return listing.select(
        "id",
        "job_title",
        "job_url",
        shown("career_category", "Uncategorized"),
        shown("company", "Unknown"),
        shown("location", "Unknown"),
        salary_label().alias("salary"),
        shown("employment_type", "Not specified"),
    )


def explorer_options(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Choices offered in the listing: ten categories and a hundred locations."""
    return (
        get_categories(jobs, 10).where("career_category <> ''"),
        get_locations(jobs, 100).where("location <> ''"),
    )
