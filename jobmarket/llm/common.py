"""Helpers shared by the training-data operators: tables, staging, prefix sums, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmarket.session import shared_dir, ship

#: most rows of a table that is sent to every executor
BROADCAST_ROWS = 10_000
#: most tasks that shards or ranges are dealt to
MOST_TASKS = 20_000


def shipping(run):
    """A query or stage whose first argument is the session, run after :func:`ship`."""

    @wraps(run)
    def shipped(spark: SparkSession, *args, **kwargs) -> DataFrame:
        ship(spark)
        return run(spark, *args, **kwargs)

    return shipped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession) -> str:
    """A new path below the shared folder of the session."""
    return f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path made by :func:`work_path`, wherever the shared folder is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors don't matter."""
    path = path or work_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sums(totals: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """``totals`` with the sum of ``amount`` over smaller keys as ``name``; for tables of bounded size only."""
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(amount).over(before), F.lit(0).cast("long")))


def by_bounded(df: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Left join to a staged lookup with one row per ``key``; both keys non-null.

    A lookup of at most :data:`BROADCAST_ROWS` rows is broadcast.  A larger one is repeated
    ``salts`` times, so that the rows of a hot key spread over as many tasks.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), key, "left")
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("__salt", (F.rand(7) * salts).cast("int")).join(salted, [key, "__salt"], "left").drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) per node, root being the smallest node reachable.

    Alternating large-star and small-star steps, until every node points at a root.  Minima are aggregated
    before the shuffle and joined back, so a node with very many neighbours never lands in one task.  Every
    step is written to the shared folder, so its plan stays small whatever came before; the steps before it
    are removed.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.where("b < a") if not large else both
        least = near.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).selectExpr("n", "least(n, m) AS m")
        joined = (both if large else near).join(least, F.col("a") == F.col("n"))
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.selectExpr("n AS a", "m AS b"))
        return out.where("a <> b").distinct()

    def done(pairs: DataFrame) -> bool:
        """Every node has one pair to a smaller one, which has none."""
        ends = pairs.selectExpr("a AS n", "1 AS down", "0 AS up").unionAll(pairs.selectExpr("b AS n", "0 AS down", "1 AS up"))
        return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR down = 1 AND up = 1").isEmpty()

    path = work_path(spark)
    pairs = staged(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), path)
    while not done(pairs):
        for large in (True, False):
            new = work_path(spark)
            pairs = staged(star(pairs, large), new)
            delete_path(spark, path)
            path = new
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def return_memory() -> None:
    """Give the memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def returning(run):
    """A kernel over record batches, after whose end a Python worker returns the memory it has freed.

    Workers are reused by later tasks; without this every one keeps the most that any task has held.
    """

    @wraps(run)
    def returned(batches):
        yield from run(batches)
        return_memory()

    return returned


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def range_cuts(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` values of ``key``, ascending, that split the rows about evenly; values that occur, never null."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(df.agg(F.percentile_approx(key, shares, 10 * parts).alias("c")).first()["c"] or []))
