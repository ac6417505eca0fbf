"""End-to-end runs: clean a set of raw postings, or collect, land, clean, import, commit.

Functions here run jobs and write tables when they are called.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.functions.titles import uncategorized_titles
from jobmarket.operators import collect as C
from jobmarket.operators.dedup import keep_first
from jobmarket.operators.quality import REPORT_COLUMNS, merged_report, partial_report, quality_report
from jobmarket.operators.standardize import clean_records, prepare
from jobmarket.operators.upsert import split_valid
from jobmarket.rules.taxonomy import DEFAULT_TAXONOMY, Taxonomy
from jobmarket.schemas import CLEAN
from jobmarket.sources import readers, writers
from jobmarket.sources.buckets import import_jobs
from jobmarket.sources.snapshots import commit_part, read_parts, write_part
from jobmarket.sources.staging import removed, staged

#: stored dedup keys are filed by hash, so that a landing reads only the files its keys may be in
KEY_BUCKETS = 256
REPORT = ", ".join(f"{c} long" for c in REPORT_COLUMNS)


@dataclass(frozen=True)
class State:
    """Folders one deployment works in.

    ``clean``, ``report`` and ``uncategorized`` are what :func:`run_clean` writes; ``landings`` holds
    clean rows, counters and keys of every landing imported by itself.
    """

    root: str

    def __getattr__(self, name: str) -> str:
        if name in ("landing", "clean", "report", "uncategorized", "jobs", "seen", "rejected", "landings"):
            return f"{self.root}/{name}"
        raise AttributeError(name)


def clean_and_report(
    raw: DataFrame,
    lookup: DataFrame,
    order: tuple[str, ...],
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
) -> tuple[DataFrame, DataFrame]:
    """(clean rows after dedup, quality report before dedup)."""
    standardized = staged(clean_records(raw, lookup, taxonomy), "standardized")
    report = quality_report(standardized, order, F.current_timestamp())
    return prepare(keep_first(standardized, "dedup_key", order)), report


def run_clean(
    raw: DataFrame,
    lookup: DataFrame,
    state: State,
    order: tuple[str, ...] = readers.LOAD_ORDER,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    csv: bool = True,
) -> DataFrame:
    """Clean, report and store: clean table, quality report, uncategorized ranking."""
    clean, report = clean_and_report(raw, lookup, order, taxonomy)
    writers.write_clean(clean, state.clean, f"{state.root}/clean_csv" if csv else None)
    stored = raw.sparkSession.read.schema(clean.schema).parquet(state.clean)
    writers.write_quality_report(report, state.report)
    writers.write_uncategorized(stored, state.uncategorized)
    return stored


def _key_bucket():
    return F.pmod(F.xxhash64("dedup_key"), F.lit(KEY_BUCKETS)).cast("int")


def stored_keys(spark: SparkSession, state: State, rows: DataFrame, without: str) -> DataFrame:
    """dedup_key of earlier landings, in the files that keys of ``rows`` may be in."""
    met = [r[0] for r in rows.select(_key_bucket()).distinct().collect()]  # at most KEY_BUCKETS
    keys = read_parts(spark, state.landings, "keys", "dedup_key string, bucket int", without)
    return keys.where(F.col("bucket").isin(met)).select("dedup_key") if met else keys.select("dedup_key").limit(0)


def import_landing(
    landed: DataFrame,
    lookup: DataFrame,
    state: State,
    part: str,
    order: tuple[str, ...] = readers.LANDING_ORDER,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    newest: bool = False,
) -> DataFrame:
    """Clean one landing, and import the first row of every dedup key that no earlier landing had.

    Only the landing is cleaned.  After the import its clean rows, counters and keys are committed together
    as a part of the state; a repeated ``part`` replaces what it stored before, and a landing that fails
    leaves nothing behind that a later one would take for imported.  Landings have to come in their order: then the
    clean rows of all parts equal what cleaning everything at once gives, and the sum of the counters is its report.
    Returns import statistics.
    """
    spark = landed.sparkSession
    rows = staged(clean_records(landed, lookup, taxonomy), "landed")
    first = staged(keep_first(rows, "dedup_key", order), "first")
    earlier = stored_keys(spark, state, first, part).withColumnRenamed("dedup_key", "_earlier")
    fresh = staged(first.join(earlier, F.col("dedup_key").eqNullSafe(F.col("_earlier")), "left_anti"), "fresh")
    prepared = prepare(fresh)
    clean = write_part(prepared, state.landings)  # counts once committed
    written = spark.read.schema(prepared.schema).parquet(f"{state.landings}/{clean}")
    statistics = run_import(written, state, part, newest, stored=True)
    folders = {
        "clean": clean,
        "report": write_part(partial_report(rows, fresh), state.landings),
        "keys": write_part(fresh.select("dedup_key", _key_bucket().alias("bucket")), state.landings, by="bucket"),
    }
    commit_part(spark, state.landings, part, **folders)
    for table in (rows, first, fresh):
        removed(table)
    return statistics


def clean_table(spark: SparkSession, state: State) -> DataFrame:
    """Clean rows of all landings."""
    return read_parts(spark, state.landings, "clean", CLEAN)


def report_table(spark: SparkSession, state: State) -> DataFrame:
    """Quality report of all landings."""
    return merged_report(read_parts(spark, state.landings, "report", REPORT))


def uncategorized_table(spark: SparkSession, state: State) -> DataFrame:
    """Ranking of the uncategorized titles of all landings."""
    return uncategorized_titles(clean_table(spark, state))


def run_import(clean: DataFrame, state: State, run_id: str | None = None, newest: bool = False, stored: bool = False) -> DataFrame:
    """Upsert the clean table into the jobs table; returns before, after, inserted.

    Rows without title or company, or with an amount too large to store, are added to the rejected
    table under ``run`` instead of failing the import.  An import repeated with the same ``run_id``
    replaces the rows it rejected before; without one every import has its own.  With ``newest`` a
    row of the table is only replaced by one that would win over it in one batch.  A table that is not
    ``stored`` is staged, so that it is worked out once.
    """
    run_id = run_id or f"import-{uuid.uuid4().hex}"
    batch = clean if stored else staged(clean, "batch")  # read for both tables
    accepted, rejected = split_valid(batch)
    before, after = import_jobs(accepted, state.jobs, newest=newest)
    rejected.write.mode("overwrite").parquet(f"{state.rejected}/run={run_id}")
    if not stored:
        removed(batch)
    return clean.sparkSession.createDataFrame([(before, after, after - before)], "before long, after long, inserted long")


def run_landing(
    spark: SparkSession, lookup: DataFrame, state: State, run_ts: str, taxonomy: Taxonomy = DEFAULT_TAXONOMY
) -> DataFrame | None:
    """Clean and import what was landed as ``run_ts``; import statistics, or None when nothing was.

    The jobs table comes out as if everything landed so far had been cleaned and imported with this run.
    """
    landed = readers.read_landing(spark, state.landing).where(F.col("run_ts") == run_ts)
    if landed.isEmpty():
        return None
    return import_landing(landed, lookup, state, run_ts, taxonomy=taxonomy, newest=True)


def run_collection(
    spark: SparkSession,
    listings: DataFrame,
    lookup: DataFrame,
    state: State,
    run_ts: str,
    source: str,
    details: DataFrame | None = None,
    pages: DataFrame | None = None,
    source_url: str | None = None,
    incremental: bool = True,
    full_history: bool = False,
    max_pages: int | None = None,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
) -> DataFrame | None:
    """Collect, land, clean, import, and only then commit the addresses as seen.

    Returns import statistics, or None when nothing is new.  A failure at any step
    leaves the seen table as it was, so the next run collects the same postings again.
    With ``full_history`` everything ever landed is cleaned again, as is needed once after rules have changed.
    """
    seen = readers.read_seen(spark, state.seen)
    fresh = C.collect_new(listings, seen, pages=pages, max_pages=max_pages, incremental=incremental)
    if details is not None:
        fresh = C.merge_details(fresh, details)
    writers.land_raw(C.with_provenance(fresh, source, run_ts, source_url), state.landing, run_ts)

    history = readers.read_landing(spark, state.landing)
    landed = history.where(F.col("run_ts") == run_ts)
    if full_history and not landed.isEmpty():
        clean = run_clean(history, lookup, state, readers.LANDING_ORDER, taxonomy, csv=False)
        statistics = run_import(clean, state, run_ts)
    else:
        statistics = run_landing(spark, lookup, state, run_ts, taxonomy)
    if statistics is None:
        return None
    new = C.union_seen(seen.limit(0), landed)
    known = seen if incremental else seen.limit(0)
    writers.commit_seen(new.join(known, "job_url", "left_anti"), state.seen, run_ts)
    return statistics
