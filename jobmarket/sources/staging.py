"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobmarket.session import shared_dir


def no_rows(spark: SparkSession, schema) -> DataFrame:
    """An empty table the planner knows to be empty, so that joins with it shuffle nothing."""
    return spark.createDataFrame([], schema).where("false")


def removed(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`staged` once its consumers are done."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps then share one computation, know its true size (which is what lets
    the planner broadcast a small table and not a large one) and survive lost
    executors without recomputing it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staging/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
