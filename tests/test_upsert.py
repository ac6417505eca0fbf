import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobmarket import evolve, import_statistics, keep_first, keep_latest, split_valid, upsert_jobs
from jobmarket.operators.upsert import number_rows
from jobmarket.schemas import CLEAN, JOB_COLUMNS, JOBS

T1 = dt.datetime(2026, 1, 1, 8)
T2 = dt.datetime(2026, 1, 2, 8)


def day(text):
    return F.lit(text + " 00:00:00").cast("timestamp")


def batch(spark, *rows):
    """Rows of (title, category, company, location, url, collected_at)."""
    names = ("job_title", "career_category", "company", "location", "job_url", "collected_at")
    data = [tuple(dict(zip(names, r)).get(f.name) for f in CLEAN) for r in rows]
    return spark.createDataFrame(data, CLEAN)


def empty(spark):
    return spark.createDataFrame([], JOBS)


def ids(df):
    return {(r.job_title, r.company): (r.id, r.job_url, str(r.created_at)[:10]) for r in df.collect()}


def test_insert_update_and_rerun(spark):
    first = batch(spark, ("A", "X", "c", "l", "u1", T2), ("B", "X", "c", "l", "u2", T1), ("C", "X", "c", "l", "u3", None))
    one = upsert_jobs(empty(spark), first, day("2026-03-01"))
    assert ids(one) == {
        ("C", "c"): (1, "u3", "2026-03-01"), ("B", "c"): (2, "u2", "2026-03-01"), ("A", "c"): (3, "u1", "2026-03-01"),
    }
    older = batch(spark, ("A", "X", "c", "l", "new", T1), ("D", "X", "c", "l", "u4", T1))
    two = upsert_jobs(one, older, day("2026-04-01"))
    assert ids(two)[("A", "c")] == (3, "new", "2026-03-01")  # no recency guard across batches
    assert ids(two)[("D", "c")] == (4, "u4", "2026-04-01")
    assert ids(two)[("B", "c")] == (2, "u2", "2026-03-01")
    again = upsert_jobs(two, older, day("2026-04-01"))
    assert ids(again) == ids(two)
    assert tuple(import_statistics(two, again).first()) == (4, 4, 0)
    assert tuple(import_statistics(one, two).first()) == (3, 4, 1)


def test_latest_wins_in_a_batch_and_null_loses(spark):
    rows = batch(
        spark, ("A", "X", "c", "l", "old", T1), ("A", "X", "c", "l", "new", T2), ("A", "X", "c", "l", "none", None),
        ("A", "X", "c", None, "other", None), ("A", "X", "c", None, "same key", T1),
    )
    assert sorted(r.job_url for r in keep_latest(rows).collect()) == ["new", "same key"]
    table = upsert_jobs(empty(spark), rows, day("2026-03-01"))
    assert table.count() == 2
    assert upsert_jobs(table, rows, day("2026-04-01")).count() == 2  # a missing location is one value


def test_rejects_and_columns(spark):
    rows = batch(spark, ("A", "X", None, "l", "u", T1), (None, "X", "c", "l", "u", T1), ("", "X", "c", "l", "u", T1))
    accepted, rejected = split_valid(rows)
    assert (accepted.count(), rejected.count()) == (1, 2)
    assert upsert_jobs(empty(spark), rows).count() == 1
    with pytest.raises(ValueError, match="job_url"):
        split_valid(rows.drop("job_url"))


def test_older_snapshot(spark):
    old = spark.createDataFrame([(5, "A", "X", "c", "l", 9)], "id long, job_title string, career_category string, company string, location string, salary_min int")
    grown = evolve(old)
    assert set(JOB_COLUMNS) <= set(grown.columns) and grown.first().salary_min == 9
    table = upsert_jobs(old, batch(spark, ("B", "X", "c", "l", "u", T1)), day("2026-03-01"))
    assert {(r.job_title, r.id, r.salary_min) for r in table.collect()} == {("A", 5, 9), ("B", 6, None)}


def test_numbers_are_dense_over_partitions(spark):
    df = spark.range(1000).repartition(7).withColumn("v", (F.col("id") * 7919) % 1000)
    rows = number_rows(df.select("v"), [F.col("v").desc()], 50, "n").collect()
    assert sorted((r.n, r.v) for r in rows) == [(51 + i, 999 - i) for i in range(1000)]


def test_keep_first_follows_load_order(spark):
    df = spark.createDataFrame([("k", "b", 0, 1), ("k", "a", 5, 2), ("k", "a", 3, 3), (None, "a", 0, 4), (None, "a", 1, 5)],
                               "dedup_key string, file_name string, ord int, v int")
    assert sorted(r.v for r in keep_first(df, "dedup_key", ["file_name", "ord"]).collect()) == [3, 4]


def test_dedup_limits_groups_before_the_shuffle(spark):
    df = spark.range(10).withColumn("dedup_key", F.col("id") % 2)
    plan = keep_first(df, "dedup_key", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
