"""Keep-one deduplication.

``row_number() = 1`` plans a group limit before the shuffle: every map task keeps at
most one row per key, so a key holding a large share of all rows does not travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobmarket.schemas import JOB_KEY


def keep_one(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    spot = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(spot)).where("_n = 1").drop("_n")


def keep_first(df: DataFrame, key: str = "dedup_key", order: Sequence[str] = ("load_order",)) -> DataFrame:
    """First row per key in load order; null is a key of its own."""
    return keep_one(df, [key], list(order))


def keep_latest(
    df: DataFrame,
    keys: Sequence[str] = JOB_KEY,
    timestamp: str = "collected_at",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Most recent row per key; a missing timestamp loses, ``tie_break`` decides ties."""
    order = [F.col(timestamp).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tie_break]]
    return keep_one(df, list(keys), order)
