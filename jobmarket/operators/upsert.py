"""Upsert of clean rows into the jobs table, as joins over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobmarket.operators.dedup import keep_latest
from jobmarket.schemas import JOB_COLUMNS, JOB_KEY, JOBS
from jobmarket.session import shared_dir


def check_columns(batch: DataFrame) -> None:
    missing = [c for c in JOB_COLUMNS if c not in batch.columns]
    if missing:
        raise ValueError(f"batch lacks required columns: {', '.join(missing)}")


def accepted_row() -> Column:
    """Title and company are required, and a disclosed amount must fit its column."""
    fits = ~F.coalesce("salary_disclosed", F.lit(False)) | F.col("salary_amount").isNotNull()
    return F.col("job_title").isNotNull() & F.col("company").isNotNull() & fits


def split_valid(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a batch; raises when a column is missing."""
    check_columns(batch)
    return batch.where(accepted_row()), batch.where(~accepted_row())


def evolve(jobs: DataFrame) -> DataFrame:
    """Bring an older snapshot to the current columns; extra old columns stay."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in JOBS if f.name not in jobs.columns}
    df = jobs.withColumns(missing) if missing else jobs
    extra = [c for c in df.columns if c not in JOBS.fieldNames()]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in JOBS], *extra)


def number_rows(df: DataFrame, order: list[Column], start: int, name: str = "id") -> DataFrame:
    """Consecutive numbers from ``start + 1`` in the given order.

    The sorted rows are checkpointed once, which fixes their partition and position;
    numbers then follow from per-partition counts, one small row per partition.
    """
    shared_dir(df.sparkSession)
    fixed = (
        df.orderBy(*order)
        .withColumn("_seq", F.monotonically_increasing_id())
        .checkpoint()
        .withColumns(
            {"_part": F.shiftrightunsigned("_seq", 33), "_pos": F.col("_seq").bitwiseAND((1 << 33) - 1)}
        )
    )
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    numbered = fixed.join(F.broadcast(offsets), "_part")  # one row per partition
    return numbered.withColumn(name, F.lit(start + 1) + F.col("_offset") + F.col("_pos")).drop(
        "_seq", "_part", "_pos", "_offset"
    )


#: a batch keeps the row that is greatest by these
NEWEST = ("collected_at", "job_url", "source", "date_posted", "salary_amount")


def latest_of_batch(batch: DataFrame) -> DataFrame:
    """The rows of a batch that an import writes: valid ones, the latest of every key."""
    check_columns(batch)
    valid = batch.where(accepted_row()).select([F.col(c).cast(JOBS[c].dataType).alias(c) for c in JOB_COLUMNS])
    return keep_latest(valid, tie_break=NEWEST[1:])


def upsert_jobs(
    jobs: DataFrame, batch: DataFrame, now: Column | None = None, top: int | None = None, newest: bool = False, latest: bool = False
) -> DataFrame:
    """New snapshot: batch rows replace rows of the same key, others are added.

    Ids and creation times of existing rows stay.  Keys compare null-safely.  The
    batch may be older than the table: the last writer wins, as in a plain upsert, unless ``newest``
    is set: then a row of the table stays that would win in one batch with the new one.
    New ids follow ``top``, by default the largest id of ``jobs``.  ``latest`` tells that the batch comes
    from :func:`latest_of_batch`, so that it is not sorted by key again.
    The table is joined once in full and once by its key columns, and never staged;
    only the added rows are, while they get their ids.
    """
    jobs = evolve(jobs)
    stamp = F.current_timestamp() if now is None else now
    rows = batch if latest else latest_of_batch(batch)
    incoming = rows.select(*[F.col(c).alias(f"_n_{c}") for c in JOB_COLUMNS], F.lit(True).alias("_incoming"))
    same = [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in JOB_KEY]
    replaced = F.coalesce("_incoming", F.lit(False))
    if newest:
        replaced &= ~(F.struct(*NEWEST) > F.struct(*[F.col(f"_n_{c}").alias(c) for c in NEWEST]))

    matched = jobs.join(incoming, same, "left").withColumn("_replaced", replaced)
    kept = matched.withColumns(
        {c: F.when(F.col("_replaced"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in JOB_COLUMNS}
    ).select(*jobs.columns)

    added = incoming.join(jobs.select(*JOB_KEY), same, "left_anti").select(
        *[F.col(f"_n_{c}").alias(c) for c in JOB_COLUMNS]
    )
    top = jobs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if top is None else top
    order = [F.col("collected_at").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in JOB_KEY]]
    added = number_rows(added, order, top).withColumn("created_at", stamp.cast("timestamp"))
    return kept.unionByName(added, allowMissingColumns=True)


def import_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts before and after an import, and how many rows it inserted."""
    sizes = before.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    counted = sizes.agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("before"), F.coalesce(F.sum("a"), F.lit(0)).alias("after")
    )
    return counted.withColumn("inserted", F.col("after") - F.col("before"))
