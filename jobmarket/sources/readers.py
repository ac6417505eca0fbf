"""Sources.  Every reader declares its schema and returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmarket.schemas import CLEAN, LOCATION_LOOKUP, RAW, SEEN
from jobmarket.sources.buckets import read_jobs_table
from jobmarket.sources.json_arrays import read_json_arrays
from jobmarket.sources.snapshots import latest_version, read_parts

#: load order of raw records: file name, then position in the file
LOAD_ORDER = ("file_name", "ord")


def read_raw(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Raw postings from files that each hold one JSON array; many tasks read one large file.

    Files whose content is no array of objects or no valid JSON yield nothing.  ``file_name``
    and ``ord`` give the load order.
    """
    return read_json_arrays(spark, path, RAW, glob)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Raw postings landed by :func:`jobmarket.sources.writers.land_raw`."""
    fields = [*RAW.fields, T.StructField("page", T.LongType()), T.StructField("pos", T.IntegerType())]
    partitions = [T.StructField("run_ts", T.StringType()), T.StructField("landed_from", T.StringType())]
    return spark.read.schema(T.StructType(fields + partitions)).json(path)


#: load order of landed postings
LANDING_ORDER = ("run_ts", "landed_from", "page", "pos")


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """Clean table written as CSV; a byte-order mark and quoted line breaks are fine."""
    return (
        spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in CLEAN]))
        .options(header=True, multiLine=True, escape='"', encoding="UTF-8")
        .csv(path)
        .select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in CLEAN])
    )


def read_psgc(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Code and description of one place table; codes stay text, zeros included.

    ``ord`` is the place of a row in the files, as of equal names the last one counts.
    Only the header tells the column order, so it is read as text and selected by name.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return (
        spark.read.options(header=True, encoding=encoding, inferSchema=False)
        .csv(path)
        .select("code", "description", place.alias("ord"))
    )


def read_location_lookup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOCATION_LOOKUP).parquet(path)


def read_seen(spark: SparkSession, root: str) -> DataFrame:
    """Addresses handled by earlier runs; no history yet means an empty table.

    Two runs at the same time may both have committed an address, which then is in the table twice.
    """
    seen = read_parts(spark, root, "seen", SEEN)
    older = latest_version(spark, root)
    return seen.unionByName(spark.read.schema(SEEN).parquet(older)) if older else seen


def read_jobs(spark: SparkSession, root: str) -> DataFrame:
    """Current jobs table, or an empty one."""
    return read_jobs_table(spark, root)
