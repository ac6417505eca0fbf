"""Lookup joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: least number of hot keys, and of keys that rows without a regular lookup are spread over
HOT_SHARE = 100
SPREAD = 4096


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, key: str, rows: str = "rows") -> DataFrame:
    """Keys holding more than half of a task's share of all rows: fewer than twice as many keys as there are tasks."""
    total = counts.agg(F.sum(rows)).scalar()
    return counts.where(F.col(rows) * max(HOT_SHARE, 2 * _tasks(counts)) > total).select(key)


def count_keys(facts: DataFrame, key: str) -> DataFrame:
    """Rows per key; partial counts keep popular keys small in the shuffle."""
    return facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """``facts`` left-joined with ``dim``, which is unique on the text column ``key``.

    Hot keys are looked up in a broadcast table, bounded as :func:`hot_keys` says.  Their
    rows, and rows without a key, then enter the regular join under keys that match
    nothing and depend on the whole row, which spreads them over all tasks.
    """
    hot = hot_keys(count_keys(facts, key), key) if hot is None else hot
    values = [c for c in dim.columns if c != key]
    packed = dim.select(key, F.struct(*values).alias("_value"))
    found = packed.join(F.broadcast(hot), key, "left_semi")
    hot_values = hot.join(F.broadcast(found), key, "left").select(
        F.col(key).alias("_hot_key"), F.col("_value").alias("_hot_value")
    )
    regular = packed.select(F.col(key).alias("_cold_key"), F.col("_value").alias("_cold_value"))
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*facts.columns), F.lit(max(SPREAD, 16 * _tasks(facts)))).cast("string"))
    apart = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    joined = (
        facts.join(F.broadcast(hot_values), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_probe", F.when(apart, spread).otherwise(F.col(key)))
        .join(regular, F.col("_probe") == F.col("_cold_key"), "left")
    )
    value = F.coalesce("_hot_value", "_cold_value")
    return joined.select(*facts.columns, *[value[c].alias(c) for c in values])
