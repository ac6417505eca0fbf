"""Queries over what sinks have written: every one writes whole tables to the shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import jobmarket as jm
from jobmarket.functions.titles import standardize_titles
from jobmarket.operators.dedup import keep_first
from jobmarket.operators.standardize import clean_records
from jobmarket.operators.upsert import upsert_jobs
from jobmarket.registry import tables as T
from jobmarket.registry.queries import QUERIES, query, texts
from jobmarket.schemas import JOB_KEY, JOBS, RAW
from jobmarket.session import shared_dir
from jobmarket.sources import readers, writers
from jobmarket.sources.buckets import adopt_jobs, import_jobs

__all__ = ["QUERIES"]

#: postings of one JSON array file
IN_FILE = 2000
FIRST, LATER = "2026-01-01 00:00:00", "2026-02-02 00:00:00"


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"


def _imports(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Earlier postings, and later ones overlapping them."""
    postings = T.repeat_postings(spark, sf)
    return postings.where("date_posted < date'1998-01-01'"), postings.where("date_posted >= date'1997-01-01'")


@query
def upsert_buckets(spark, sf):
    """Two imports into the bucketed jobs table."""
    root = folder(spark)
    for batch, stamp in zip(_imports(spark, sf), (FIRST, LATER)):
        import_jobs(batch, root, F.lit(stamp).cast("timestamp"))
    jobs = readers.read_jobs(spark, root)
    return texts(jobs.select("id", *JOB_KEY, "region", "salary_amount", "job_url", "collected_at", "created_at"))


@query
def upsert_older_table(spark, sf):
    """An import into a table of an earlier release, with fewer columns and one that is no longer written."""
    root = folder(spark)
    first, second = _imports(spark, sf)
    older = upsert_jobs(spark.createDataFrame([], JOBS), first)
    adopt_jobs(older.select("id", *JOB_KEY, "region", (F.col("id") * 10).alias("salary_min")), root)
    import_jobs(second, root, F.lit(LATER).cast("timestamp"))
    jobs = readers.read_jobs(spark, root)
    return texts(jobs.select("id", *JOB_KEY, "region", "salary_min", "job_url", "created_at"))


@query
def import_rejects(spark, sf):
    """Postings that an import sets aside."""
    state = jm.State(folder(spark))
    jm.run_import(T.repeat_postings(spark, sf), state, "one")
    return spark.read.parquet(state.rejected).select("job_url", "job_title", "company")


def write_arrays(postings: DataFrame, path: str) -> None:
    """JSON array files of :data:`IN_FILE` postings each."""
    columns = [c for c in postings.columns if c in RAW.fieldNames()]
    named = postings.select("posting_id", F.expr(f"posting_id div {IN_FILE}").alias("file"), F.to_json(F.struct(*columns)).alias("record"))
    in_file = Window.partitionBy("file")
    place = F.row_number().over(in_file.orderBy("posting_id"))
    lines = named.withColumns({"place": place, "last": F.count("*").over(in_file)}).select(
        "file", "place", F.concat(F.when(F.col("place") == 1, "[").otherwise(","), "record", F.when(F.col("place") == F.col("last"), "]").otherwise("")).alias("value"),
    )
    lines.repartition("file").sortWithinPartitions("file", "place").drop("place").write.partitionBy("file").text(path)


@query
def raw_arrays(spark, sf):
    """Postings read from JSON array files, with their place in the file."""
    path = folder(spark)
    write_arrays(T.raw_postings(spark, sf), path)
    return readers.read_raw(spark, path, "*.txt").select(
        "ord", "job_title", "salary_text", "salary", "company", "employer", "organization", "location", "education_requirement", "date_posted", "job_url",
    )


def _landing(spark, sf) -> DataFrame:
    """Postings as the collector lands them, fifty on a page."""
    raw = T.raw_postings(spark, sf)
    missing = {f.name: F.lit(None).cast("string") for f in RAW if f.name not in raw.columns}
    return raw.withColumns({**missing, "page": F.expr("posting_id div 50"), "pos": F.expr("int(posting_id % 50)")})


@query
def landing_round_trip(spark, sf):
    """Postings landed by two runs."""
    path = folder(spark)
    for run in (0, 1):
        writers.land_raw(_landing(spark, sf).where(F.col("page") % 2 == run), path, f"2026010{run + 1}T000000Z")
    return readers.read_landing(spark, path).select("run_ts", "landed_from", "page", "pos", "job_title", "salary_text", "company", "location", "job_url")


def _lookup(spark, sf) -> DataFrame:
    return jm.build_location_lookup(*T.place_tables(spark, sf), order="ord")


@query
def clean_csv(spark, sf):
    """Clean table written as Parquet and CSV, read from the CSV."""
    path = folder(spark)
    rows = keep_first(clean_records(T.raw_postings(spark, sf), _lookup(spark, sf)), "dedup_key", ["posting_id"])
    writers.write_clean(jm.prepare(rows), f"{path}/parquet", f"{path}/csv")
    return texts(readers.read_clean_csv(spark, f"{path}/csv").drop("industry", "description"))


def _landed(spark, sf) -> jm.State:
    """State after two landings, each cleaned and imported by itself."""
    state, lookup = jm.State(folder(spark)), _lookup(spark, sf)
    landing = _landing(spark, sf)
    half = landing.agg(F.expr("max(page) div 2")).scalar()
    for run, rows in (("20260101T000000Z", landing.where(F.col("page") < half)), ("20260102T000000Z", landing.where(F.col("page") >= half))):
        writers.land_raw(rows, state.landing, run)
        jm.run_landing(spark, lookup, state, run)
    return state


@query
def landings_report(spark, sf):
    """Quality report of two landings, from their counters, written and read as JSON."""
    state = _landed(spark, sf)
    writers.write_quality_report(jm.report_table(spark, state), state.report)
    return spark.read.schema(jm.report_table(spark, state).schema).json(state.report)


@query
def landings_jobs(spark, sf):
    """Jobs table after two landings: what one import of all postings gives."""
    jobs = readers.read_jobs(spark, _landed(spark, sf).jobs)
    return texts(jobs.select(*JOB_KEY, "region", "salary_amount", "salary_amount_monthly", "job_url", "collected_at"))


@query
def uncategorized_csv(spark, sf):
    path = folder(spark)
    writers.write_uncategorized(standardize_titles(T.raw_postings(spark, sf)), path)
    return spark.read.schema("job_title string, count long").csv(path, header=True)


@query
def seen_commits(spark, sf):
    """History after two runs have committed their addresses."""
    root = folder(spark)
    listings, seen = T.crawl_tables(spark, sf)
    writers.commit_seen(seen, root, "1")
    writers.commit_seen(jm.only_unseen(listings, readers.read_seen(spark, root)), root, "2")
    return readers.read_seen(spark, root)


@query
def lookup_from_csv(spark, sf):
    """Location lookup from place tables written as CSV; of equal names the last in the files is kept."""
    path, files = folder(spark), []
    for name, places in zip(("region", "province", "muncity"), T.place_tables(spark, sf)):
        places.orderBy("ord").select("ord", "code", "description").write.option("encoding", "ISO-8859-1").csv(f"{path}/{name}", header=True)
        files.append(readers.read_psgc(spark, f"{path}/{name}"))
    return jm.build_location_lookup(*files, order="ord")


@query
def lookup_renamed(spark, sf):
    """Stored location lookup with outdated region names replaced."""
    path = folder(spark)
    regions, provinces, towns = T.place_tables(spark, sf)
    regions = regions.withColumn("description", F.when(F.col("description") == "ASIA", "ARMM").otherwise(F.col("description")))
    jm.build_location_lookup(regions, provinces, towns, order="ord", fix_regions=True).write.parquet(path)
    return readers.read_location_lookup(spark, path)


@query
def jobs_sanitized(spark, sf):
    """A page asked for with a number that is none and a limit beyond the largest."""
    return texts(jm.list_jobs(T.jobs_view(spark, sf), page="x", limit="1e9"))
