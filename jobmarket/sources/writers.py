"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmarket.functions.titles import uncategorized_titles
from jobmarket.schemas import RAW
from jobmarket.sources.snapshots import commit_part, write_part


def land_raw(postings: DataFrame, path: str, run_ts: str, suffix: str = "") -> None:
    """Append the raw postings of one run; earlier runs are never touched."""
    columns = [f.name for f in RAW] + [c for c in ("page", "pos") if c in postings.columns]
    (
        postings.select(*columns, F.lit(run_ts + suffix).alias("run_ts"), F.col("source").alias("landed_from"))
        .write.mode("append")
        .partitionBy("run_ts", "landed_from")
        .json(path)
    )


def write_clean(clean: DataFrame, path: str, csv_path: str | None = None) -> None:
    """Clean table as Parquet and, for interchange, as CSV."""
    out = clean.drop("salary_min", "salary_max")
    out.write.mode("overwrite").parquet(path)
    if csv_path:
        out.sparkSession.read.schema(out.schema).parquet(path).write.mode("overwrite").options(
            header=True, escape='"', encoding="UTF-8", timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
        ).csv(csv_path)


def write_quality_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)  # one row


def write_uncategorized(clean: DataFrame, path: str) -> None:
    """Ranking of titles without a category, as CSV files in rank order."""
    uncategorized_titles(clean).write.mode("overwrite").option("header", True).csv(path)


def commit_seen(new: DataFrame, root: str, run_ts: str) -> None:
    """Add the addresses of a run to the history; a repeated run replaces its own."""
    folder = write_part(new.select("job_url").distinct(), root)
    commit_part(new.sparkSession, root, run_ts, seen=folder)
