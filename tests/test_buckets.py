"""Tables under commits: racing writers, and imports that touch few buckets."""

import datetime as dt
from pathlib import Path

import pytest

from jobmarket.schemas import CLEAN
from jobmarket.sources import buckets, readers, snapshots, writers
from jobmarket.sources.buckets import adopt_jobs, import_jobs


def batch(spark, *rows):
    names = ("job_title", "career_category", "company", "location", "job_url", "collected_at")
    data = [tuple(dict(zip(names, r)).get(f.name) for f in CLEAN) for r in rows]
    return spark.createDataFrame(data, CLEAN)


def row(i, url="u", day=1):
    return (f"t{i}", "X", "c", None if i % 5 == 0 else "l", f"{url}{i}", dt.datetime(2026, 1, day, i % 24))


def files(root):
    return {p for p in (Path(root) / "data").rglob("*.parquet")}


def test_small_import_writes_few_buckets(spark, tmp_path):
    root = str(tmp_path / "jobs")
    assert import_jobs(batch(spark, *[row(i) for i in range(500)]), root) == (0, 500)
    before, number = files(root), snapshots.read_commit(spark, root)
    assert len(before) > 50
    assert import_jobs(batch(spark, row(7, "new"), row(1000), row(1001)), root) == (500, 502)
    assert len(files(root) - before) <= 3 and before <= files(root)
    content = snapshots.read_commit(spark, root)[1]
    carried = [b for b, f in content["folders"].items() if number[1]["folders"].get(b) == f]
    assert len(carried) >= len(number[1]["folders"]) - 3 and content["top"] == 502
    rows = {r.job_title: r for r in readers.read_jobs(spark, root).collect()}
    assert len(rows) == 502 and rows["t7"].job_url == "new7" and sorted(r.id for r in rows.values()) == list(range(1, 503))
    assert import_jobs(batch(spark), root) == (502, 502) and snapshots.read_commit(spark, root)[0] == 2


def test_newest_row_stays(spark, tmp_path):
    root = str(tmp_path / "jobs")
    import_jobs(batch(spark, row(1, "b", 2), row(2, "b", 2)), root)
    import_jobs(batch(spark, row(1, "a", 1), row(2, "c", 2)), root, newest=True)
    assert {r.job_url for r in readers.read_jobs(spark, root).collect()} == {"b1", "c2"}
    import_jobs(batch(spark, row(1, "a", 1)), root)
    assert {r.job_url for r in readers.read_jobs(spark, root).collect()} == {"a1", "c2"}


def race(monkeypatch, module, between):
    """Let ``between`` happen once, after the first writer has read its commit."""
    read, done = snapshots.read_commit, []

    def slow(spark, root):
        found = read(spark, root)
        if not done:
            done.append(1)
            between()
        return found

    monkeypatch.setattr(module, "read_commit", slow)


def test_racing_imports_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "jobs")
    import_jobs(batch(spark, *[row(i) for i in range(20)]), root)
    race(monkeypatch, snapshots, lambda: import_jobs(batch(spark, row(3, "first"), row(100)), root))
    assert import_jobs(batch(spark, row(3, "second"), row(101)), root) == (21, 22)
    rows = {r.job_title: r for r in readers.read_jobs(spark, root).collect()}
    assert len(rows) == 22 and rows["t3"].job_url == "second3"
    assert (rows["t100"].id, rows["t101"].id) == (21, 22) and snapshots.read_commit(spark, root)[0] == 3


def test_racing_histories_lose_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "seen")
    seen = lambda *urls: spark.createDataFrame([(u,) for u in urls], "job_url string")
    writers.commit_seen(seen("a"), root, "1")
    race(monkeypatch, snapshots, lambda: writers.commit_seen(seen("b", "d"), root, "2"))
    writers.commit_seen(seen("c", "d"), root, "3")
    writers.commit_seen(seen("c", "d"), root, "3")
    assert sorted(r[0] for r in readers.read_seen(spark, root).collect()) == ["a", "b", "c", "d", "d"]


def test_writer_gives_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "_create", lambda *_: False)
    with pytest.raises(RuntimeError, match="faster"):
        snapshots.update(spark, str(tmp_path), lambda old: old)


def test_older_columns(spark, tmp_path):
    root = str(tmp_path / "jobs")
    old = spark.createDataFrame([(5, "t1", "X", "c", "l", 9), (8, "t2", "X", "c", "l", 7)], "id long, job_title string, career_category string, company string, location string, salary_min int")
    adopt_jobs(old, root)
    assert adopt_jobs(old, root)["top"] == 8 and snapshots.read_commit(spark, root)[0] == 1
    assert import_jobs(batch(spark, row(1), row(3)), root) == (2, 3)
    rows = {r.job_title: r for r in readers.read_jobs(spark, root).collect()}
    assert {(t, r.id, r.salary_min, r.job_url) for t, r in rows.items()} == {("t1", 5, 9, "u1"), ("t2", 8, 7, None), ("t3", 9, None, "u3")}
    assert import_jobs(batch(spark), str(tmp_path / "none")) == (0, 0) and readers.read_jobs(spark, str(tmp_path / "none")).count() == 0


def test_bucket_of_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "x string, y string")
    assert all(0 <= r[0] < 7 for r in df.select(buckets.bucket(["x", "y"], 7)).collect())


def test_import_finds_the_latest_rows_once(spark, tmp_path, monkeypatch):
    from jobmarket.operators import upsert

    monkeypatch.setattr(upsert, "latest_of_batch", None)  # import_jobs calls it by itself, no further step has to
    root = str(tmp_path / "jobs")
    assert import_jobs(batch(spark, row(1), row(1, "v", 2), row(2)), root) == (0, 2)
    assert import_jobs(batch(spark, row(2, "v"), row(3), row(3)), root) == (2, 3)
    assert {r.job_url for r in readers.read_jobs(spark, root).collect()} == {"v1", "v2", "u3"}


def test_first_import_joins_nothing(spark, tmp_path, monkeypatch):
    plans = []
    write = buckets._write
    monkeypatch.setattr(buckets, "_write", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a))
    for first in (True, False):
        import_jobs(batch(spark, row(1), row(2)), str(tmp_path / "jobs"))
    assert "LeftOuter" not in plans[0] and "LeftOuter" in plans[1]


def test_industry_puts_its_text_together_once(spark):
    from jobmarket.functions.industry import DERIVED, derived_industry, with_industry

    rows = [("Nurse", None, None), (None, "a SALES desk", " "), (None, None, None), ("x", "y", "Stated")]
    jobs = spark.createDataFrame(rows, "job_title string, description string, industry string")
    found = with_industry(jobs)
    assert found.columns == [*jobs.columns, DERIVED]
    assert found.collect() == jobs.withColumn(DERIVED, derived_industry()).collect()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
