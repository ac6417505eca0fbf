"""Landed postings as a file stream: each micro-batch is cleaned and upserted.

The stream checkpoint remembers which landing files are done, and the upsert makes a
repeated batch harmless, so a restarted job neither loses nor doubles postings.

Of postings with one ``dedup_key`` the first landed is imported, however the landing files
fall into batches: the keys of earlier batches are stored, and each batch is held against those
that are filed with its own.  A batch that is repeated after a failure replaces its own keys and its own rejected rows.
Files must arrive in landing order; a file that arrives late counts as landed late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobmarket.plans.run import State, import_landing
from jobmarket.rules.taxonomy import DEFAULT_TAXONOMY, Taxonomy
from jobmarket.schemas import RAW
from jobmarket.sources.readers import LANDING_ORDER


def landing_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    fields = [*RAW.fields, T.StructField("page", T.LongType()), T.StructField("pos", T.IntegerType())]
    partitions = [T.StructField("run_ts", T.StringType()), T.StructField("landed_from", T.StringType())]
    return (
        spark.readStream.schema(T.StructType(fields + partitions))
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def start_incremental_import(
    spark: SparkSession,
    state: State,
    lookup: DataFrame,
    checkpoint: str,
    taxonomy: Taxonomy = DEFAULT_TAXONOMY,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Import everything landed since the last call, then stop."""

    def import_batch(batch: DataFrame, number: int) -> None:
        import_landing(batch, lookup, state, f"batch-{number:012d}", LANDING_ORDER, taxonomy)

    return (
        landing_stream(spark, state.landing, files_per_batch)
        .writeStream.foreachBatch(import_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
