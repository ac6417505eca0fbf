"""A table with a unique key, stored in buckets by the hash of the key.

A commit names the folder of every bucket.  An import reads and writes only the buckets its keys fall
into; all others are carried over by reference, so its cost follows the batch and not the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmarket.functions.industry import DERIVED, with_industry
from jobmarket.operators.upsert import evolve, latest_of_batch, upsert_jobs
from jobmarket.schemas import JOB_KEY, JOBS
from jobmarket.sources.snapshots import latest_version, read_commit, update
from jobmarket.sources.staging import no_rows, removed, staged

#: buckets of a new table; about as many as its size in parts of 256 MB
BUCKETS = 64


def bucket(keys: Sequence[str], buckets: int) -> Column:
    """Bucket of a row; nulls are values like any other."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, root: str, content: dict, wanted: Iterable[int] | None = None) -> DataFrame | None:
    """The rows of some or all buckets of a commit; a file that lacks a column has nulls there."""
    folders = content.get("folders", {})
    chosen = folders.values() if wanted is None else [folders[b] for b in map(str, wanted) if b in folders]
    if not folders:
        return None
    schema = T.StructType.fromJson(content["schema"])
    paths = [f"{root}/{folder}" for folder in chosen]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(df: DataFrame, root: str, buckets: int) -> dict[str, dict]:
    """Write rows by bucket; folder, number of rows and largest id of every bucket."""
    folder = f"data/{uuid.uuid4().hex}"
    placed = df.withColumn("bucket", bucket(JOB_KEY, buckets))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}")
    if df.sparkSession.read.schema("id long, bucket int").parquet(f"{root}/{folder}").isEmpty():
        return {}
    written = df.sparkSession.read.schema("id long, bucket int").parquet(f"{root}/{folder}")
    sums = written.groupBy("bucket").agg(F.count("*").alias("n"), F.max("id").alias("top")).collect()  # a row per bucket
    return {str(r.bucket): {"folder": f"{folder}/bucket={r.bucket}", "rows": r.n, "top": r.top or 0} for r in sums}


def _content(old: dict, schema: T.StructType, written: dict[str, dict], buckets: int) -> dict:
    carried = {k: old.get(k, {}) for k in ("folders", "rows")}
    return {
        "buckets": buckets,
        "schema": schema.jsonValue(),
        "folders": {**carried["folders"], **{b: w["folder"] for b, w in written.items()}},
        "rows": {**carried["rows"], **{b: w["rows"] for b, w in written.items()}},
        "top": max([old.get("top", 0), *(w["top"] for w in written.values())]),
    }


def _stored(jobs: DataFrame) -> DataFrame:
    """With the derived industry, which filters can push down."""
    return with_industry(jobs.drop(DERIVED))


def adopt_jobs(jobs: DataFrame, root: str, buckets: int = BUCKETS) -> dict:
    """Make a plain table, whose columns may be those of an earlier release, the first commit."""
    def change(content: dict) -> dict | None:
        if content:
            return None
        table = _stored(evolve(jobs))
        return _content({}, table.schema, _write(table, root, buckets), buckets)

    return update(jobs.sparkSession, root, change)


def import_jobs(batch: DataFrame, root: str, now: Column | None = None, newest: bool = False, buckets: int = BUCKETS) -> tuple[int, int]:
    """Upsert a batch into the table at ``root``; the numbers of rows before and after.

    Rules are those of :func:`jobmarket.operators.upsert.upsert_jobs`.  Ids go on from the largest one of
    the commit the import starts from; when another import was faster, it starts again from that one's commit.
    An empty batch commits nothing.  A table in version folders is adopted first.
    """
    spark = batch.sparkSession
    older = latest_version(spark, root)
    if older and not read_commit(spark, root)[0]:
        adopt_jobs(spark.read.parquet(older), root, buckets)
    incoming = staged(latest_of_batch(batch), "incoming")
    counts = [0, 0]

    def change(content: dict) -> dict | None:
        number = content.get("buckets", buckets)
        touched = [r[0] for r in incoming.select(bucket(JOB_KEY, number)).distinct().collect()]  # a row per bucket
        counts[0] = counts[1] = sum(content.get("rows", {}).values())
        if not touched:
            return None
        old = read_buckets(spark, root, content, touched)
        old = no_rows(spark, JOBS) if old is None else old
        table = _stored(upsert_jobs(old, incoming, now, content.get("top", 0), newest, latest=True))
        new = _content(content, table.schema, _write(table, root, number), number)
        counts[1] = sum(new["rows"].values())
        return new

    update(spark, root, change)
    removed(incoming)
    return counts[0], counts[1]


def read_jobs_table(spark: SparkSession, root: str) -> DataFrame:
    """The jobs table of the newest commit, an older release's table, or an empty one."""
    table = read_buckets(spark, root, read_commit(spark, root)[1])
    if table is None:
        older = latest_version(spark, root)
        table = spark.read.parquet(older) if older else spark.createDataFrame([], JOBS)
    return table
