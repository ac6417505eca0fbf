"""Sharding by a keyed permutation of global row numbers.

Every row gets a number from 0 to n-1 and a Feistel network over Z_a x Z_b (a*b >= n, less
than one column too many) permutes the numbers; a result outside 0..n-1 is permuted again
until it falls inside (cycle walking).  Position p of the permutation is slot ``p div shards``
of shard ``p mod shards``, so shard sizes differ by one row at most, and :func:`locate`
computes shard and slot of any row number without data.

DataFrame functions only.  Only ids, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobmarket.llm.common import prefix_sums, table, text_or_empty

#: row numbers are dealt out in so many hash ranges, each numbered by itself
RANGES = 4096
#: longest array that one row of repeated documents is unfolded with
UNFOLD = 65_536
ROUND_KEYS = (0x3C6EF372, 0x1B873593, 0x27D4EB2F, 0x165667B1, 0x2545F491, 0x5BD1E995)
PRIME = 4_294_967_291


def _sides(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _mix(x, key, shift):
    """Round function on numbers below 2**31; the same for columns and Python integers."""
    y = (x + key) * 1_597_334_677 % PRIME
    return (shift(y, 15) + y) * 1_181_783_497 % PRIME


def _permuted(p: Column, n: int, seed: int) -> Column:
    """One pass of the network: every round changes one half and swaps the halves and their sizes."""
    a, b = _sides(n)
    start = F.struct(
        (p % a).alias("x"),
        F.floor(p / a).cast("long").alias("y"),
        F.lit(a).cast("long").alias("mx"),
        F.lit(b).cast("long").alias("my"),
    )
    keys = F.array(*[F.lit(k ^ seed).cast("long") for k in ROUND_KEYS])
    one = lambda s, k: F.struct(
        s["y"].alias("x"),
        ((s["x"] + _mix(s["y"], k, F.shiftright)) % s["mx"]).alias("y"),
        s["my"].alias("mx"),
        s["mx"].alias("my"),
    )
    return F.aggregate(keys, start, one, lambda s: s["y"] * a + s["x"])


def permuted(row: Column, n: int, seed: int) -> Column:
    """Position of a row number in the permutation of 0..n-1."""
    a, b = _sides(n)
    walk = lambda p, steps: F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        p,
        lambda q, _: F.when(q < n, q).otherwise(_permuted(q, n, seed)),
    )
    first = walk(_permuted(row, n, seed), 3)
    # a walk leaves 0..n-1 for at most a*b-n steps, so this loop always ends inside
    return F.when(first < n, first).otherwise(walk(first, max(1, a * b - n))) if a * b > n else _permuted(row, n, seed)


def locate(row: int, n: int, shards: int, seed: int = 7) -> tuple[int, int]:
    """(shard, slot) of a row number, computed without data."""
    a, b = _sides(n)
    p = row
    while True:
        x, y = p % a, p // a
        for i, key in enumerate(ROUND_KEYS):
            if i % 2 == 0:
                x = (x + _mix(y, key ^ seed, int.__rshift__)) % a
            else:
                y = (y + _mix(x, key ^ seed, int.__rshift__)) % b
        p = y * a + x
        if p < n:
            return p % shards, p // shards


def numbered(keys: DataFrame) -> DataFrame:
    """Distinct rows of ``keys`` with their count as runs of global row numbers: ``first`` and ``copies``.

    Rows are ordered by a hash of all columns, then by the columns.  Equal rows are counted before
    the shuffle, so a row repeated very often stays one row.
    """
    names = keys.columns
    runs = keys.groupBy(names).agg(F.count("*").alias("copies")).withColumn("hash", F.xxhash64(*names))
    runs = runs.withColumn("range", F.shiftrightunsigned("hash", 52).cast("int"))
    starts = prefix_sums(runs.groupBy("range").agg(F.sum("copies").alias("in_range")), "range", "in_range", "start")
    before = Window.partitionBy("range").orderBy("hash", *names).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("copies").over(before), F.lit(0))
    # at most RANGES rows are broadcast
    return runs.join(F.broadcast(starts), "range").select(*names, "copies", (F.col("start") + inside).alias("first"))


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """Shard and slot of every document under the law ``rows``: counts differ by one at most.

    Columns doc_id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard (null).
    A null text counts as empty.  Repeated rows each get a slot of their own; which of two equal
    rows gets which is not defined, and does not change the result.  Other columns are ignored.
    An empty table gives an empty result.
    """
    text = text_or_empty()
    keys = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    n = docs.count()
    runs = numbered(keys)
    # repeated rows are unfolded in two steps, in pieces of bounded length
    pieces = runs.withColumn("piece", F.explode(F.expr(f"sequence(0L, (copies - 1) div {UNFOLD})")))
    rows = pieces.withColumn(
        "row", F.explode(F.expr(f"sequence(first + piece * {UNFOLD}, first + least(copies, (piece + 1) * {UNFOLD}) - 1)"))
    )
    position = permuted(F.col("row"), max(n, 1), seed)
    return rows.withColumn("position", position).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
