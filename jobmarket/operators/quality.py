"""Data-quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.rules import places as P
from jobmarket.rules.taxonomy import UNCATEGORIZED

#: counters in report order
REPORT_COLUMNS = (
    "total_records", "duplicate_records", "missing_salaries", "missing_company",
    "missing_locations", "unmapped_locations", "ambiguous_locations", "overseas_postings",
    "missing_titles", "uncategorized_titles", "fuzzy_matched_titles",
    "salary_period_inferred_daily", "salary_period_inferred_weekly",
    "salary_period_inferred_monthly", "salary_period_ambiguous", "salary_outliers_flagged",
    "salary_records_monthly_normalized", "salary_records_period_estimated", "valid_records",
)


def _conditions() -> dict[str, Column]:
    inferred = F.col("salary_period_inferred")
    return {
        "missing_salaries": ~F.col("salary_disclosed"),
        "missing_company": F.col("company").isNull(),
        "missing_locations": F.col("location") == P.UNKNOWN,
        "unmapped_locations": F.col("region").isNull() & ~F.col("location").isin(P.UNKNOWN, P.REMOTE),
        "ambiguous_locations": F.col("region") == P.AMBIGUOUS,
        "overseas_postings": F.col("region") == P.OVERSEAS,
        "missing_titles": F.coalesce("job_title", F.lit("")) == "",
        "uncategorized_titles": F.col("career_category") == UNCATEGORIZED,
        "fuzzy_matched_titles": F.col("title_match_method").startswith("fuzzy"),
        "salary_period_inferred_daily": inferred == "daily",
        "salary_period_inferred_weekly": inferred == "weekly",
        "salary_period_inferred_monthly": inferred == "monthly",
        "salary_period_ambiguous": inferred == "ambiguous",
        "salary_outliers_flagged": F.col("salary_outlier"),
        "salary_records_monthly_normalized": F.col("salary_amount_monthly").isNotNull(),
        "salary_records_period_estimated": F.col("salary_period_estimated"),
    }


def _usable() -> Column:
    """Whether a row that no earlier one repeats is a valid record."""
    return (
        (F.coalesce("job_title", F.lit("")) != "")
        & F.col("company").isNotNull()
        & (F.coalesce("location", F.lit(P.UNKNOWN)) != P.UNKNOWN)
    )


def _total(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def partial_report(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """The report's counters for one landing, to be added to those of the landings before it.

    ``rows`` are all its rows, ``fresh`` the first row of every dedup key that no earlier landing had.
    Both are only counted, so nothing but one row per task is shuffled.
    """
    kept = fresh.agg(F.count("*").alias("kept"), F.count_if(_usable()).alias("valid"))
    counters = rows.agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in _conditions().items()])
    kept_rows, valid = kept.select("kept").scalar(), kept.select("valid").scalar()
    return counters.withColumns(
        {"total_records": F.col("n"), "duplicate_records": F.col("n") - kept_rows, "valid_records": valid}
    ).select([F.col(c).cast("bigint").alias(c) for c in REPORT_COLUMNS])


def merged_report(parts: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """Sum of partial reports: the report of all their landings together."""
    report = parts.agg(*[_total(c).alias(c) for c in REPORT_COLUMNS])
    return report if generated_at is None else report.withColumn("generated_at", generated_at)


def quality_report(
    clean: DataFrame, order: Sequence[str] = ("load_order",), generated_at: Column | None = None
) -> DataFrame:
    """One row of counters over the rows *before* deduplication.

    Rows are first folded per dedup key, with partial sums in the map tasks, so a key
    with very many copies costs one row per task.  A key's first row in load order
    tells whether it yields a valid record.
    """
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    conditions = _conditions()
    per_key = clean.groupBy("dedup_key").agg(
        F.count("*").alias("n"),
        F.min_by(_usable(), position).alias("usable"),
        *[F.count_if(c).alias(name) for name, c in conditions.items()],
    )

    report = per_key.agg(
        _total("n").alias("total_records"),
        _total(F.col("n") - 1).alias("duplicate_records"),
        *[_total(name).alias(name) for name in conditions],
        F.count_if("usable").alias("valid_records"),
    ).select(*REPORT_COLUMNS)
    return report if generated_at is None else report.withColumn("generated_at", generated_at)
