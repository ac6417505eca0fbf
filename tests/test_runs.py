import json
import random

import pytest
from pyspark.sql import functions as F

import jobmarket as jm
from jobmarket.operators import collect
from jobmarket.plans import run as plans_run
from jobmarket.sources import readers, writers
from jobmarket.sources.buckets import import_jobs
from jobmarket.sources.snapshots import latest_version, read_commit
from jobmarket.streaming.incremental import start_incremental_import


def posting(n, **changes):
    row = {
        "job_title": "NURSE", "salary_text": "P15,000", "employer": f"EMPLOYER {n % 3}",
        "location": "CITY OF MAKATI, NCR, FOURTH DISTRICT", "education_requirement": "COLLEGE GRADUATE",
        "employment_type": "Permanent", "date_posted": "8/31/2026", "job_url": f"https://jobs.example.com/{n}",
        "raw_row_text": "x", "source": "portal", "collected_at": f"2026-08-{20 + n % 9:02d}T07:01:31.776733+00:00",
    }
    return {**row, **changes}


@pytest.fixture
def raw_folder(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    first = [posting(1, salary_text="610"), posting(2, location="EUROPE", employment_type="Job type not specified")]
    second = [
        posting(1, salary_text="999999", collected_at="2026-08-30T00:00:00+00:00"),
        posting(3, job_title="  ", salary_text="Salary not specified"),
        posting(4, employer=None, company="", organization="  "),
        posting(5, job_title="Line one\nline \"two\", nurse", salary_text="7,000", description="ünïcode"),
    ]
    (folder / "b.json").write_text(json.dumps(second, indent=2), encoding="utf-8")
    (folder / "a.json").write_text(json.dumps(first), encoding="utf-8")
    (folder / "c.json").write_text('{"job_title": "no array"}', encoding="utf-8")
    (folder / "d.json").write_text('[{"job_title": "broken"', encoding="utf-8")
    (folder / "f.json").write_text("\ufeff[]", encoding="utf-8")
    (folder / "e.txt").write_text("[]", encoding="utf-8")
    return str(folder)


def test_raw_reader(spark, raw_folder):
    rows = readers.read_raw(spark, raw_folder).orderBy(*readers.LOAD_ORDER).collect()
    assert [(r.file_name, r.ord, r.job_url[-1]) for r in rows] == [
        ("a.json", 0, "1"), ("a.json", 1, "2"), ("b.json", 0, "1"), ("b.json", 1, "3"), ("b.json", 2, "4"), ("b.json", 3, "5"),
    ]


def test_clean_import_and_repeat(spark, raw_folder, lookup, tmp_path):
    state = jm.State(str(tmp_path / "state"))
    clean = jm.run_clean(readers.read_raw(spark, raw_folder), lookup, state)
    report = spark.read.json(state.report).first().asDict()
    report.pop("generated_at")
    assert report == {
        "total_records": 6, "duplicate_records": 1, "missing_salaries": 1, "missing_company": 1, "missing_locations": 0,
        "unmapped_locations": 0, "ambiguous_locations": 0, "overseas_postings": 1, "missing_titles": 1,
        "uncategorized_titles": 1, "fuzzy_matched_titles": 0, "salary_period_inferred_daily": 1,
        "salary_period_inferred_weekly": 0, "salary_period_inferred_monthly": 3, "salary_period_ambiguous": 1,
        "salary_outliers_flagged": 0, "salary_records_monthly_normalized": 4, "salary_records_period_estimated": 4,
        "valid_records": 3,
    }
    first = clean.where("job_url like '%/1'").first()
    assert (str(first.salary_amount), str(first.salary_amount_monthly)) == ("610.00", "13420.00")
    from_csv = readers.read_clean_csv(spark, f"{state.root}/clean_csv")
    assert from_csv.count() == 5 and from_csv.exceptAll(clean.withColumn("job_title", F.nullif("job_title", F.lit("")))).count() <= 1
    assert spark.read.option("header", True).csv(state.uncategorized).count() == 1

    assert tuple(jm.run_import(clean, state, "a").first()) == (0, 4, 4)
    assert tuple(jm.run_import(clean, state, "a").first()) == (4, 4, 0)
    assert spark.read.parquet(state.rejected).count() == 1
    jobs = readers.read_jobs(spark, state.jobs)
    assert "industry_derived" in jobs.columns and sorted(r.id for r in jobs.collect()) == [1, 2, 3, 4]
    assert read_commit(spark, state.jobs)[0] == 2


def listings(spark, pages):
    rows = [
        (p, i, "NURSE", "P15,000", f"EMPLOYER {u}", "Cebu", "HS", "Permanent", "8/31/2026", f"https://j/{u}", "x")
        for p, urls in pages.items() for i, u in enumerate(urls)
    ]
    return spark.createDataFrame(rows, jm.schemas.LISTING)


def test_collection_commits_last(spark, lookup, tmp_path, monkeypatch):
    state = jm.State(str(tmp_path / "state"))
    args = dict(lookup=lookup, state=state, source="portal")
    stats = jm.run_collection(spark, listings(spark, {1: "ab", 2: "bc"}), run_ts="20260101T000000Z", **args)
    assert tuple(stats.first()) == (0, 3, 3)
    assert sorted(r.job_url for r in readers.read_seen(spark, state.seen).collect()) == ["https://j/a", "https://j/b", "https://j/c"]

    # nothing new: no import, no further snapshot
    assert jm.run_collection(spark, listings(spark, {1: "ab"}), run_ts="20260102T000000Z", **args) is None
    assert read_commit(spark, state.jobs)[0] == 1

    # a failing import leaves the history alone, the next run collects the same again
    def fail(*_, **__):
        raise RuntimeError("import failed")

    newer = listings(spark, {1: "da", 2: "ab"})
    with monkeypatch.context() as m:
        m.setattr(plans_run, "run_import", fail)
        with pytest.raises(RuntimeError):
            jm.run_collection(spark, newer, run_ts="20260103T000000Z", **args)
    assert readers.read_seen(spark, state.seen).count() == 3
    stats = jm.run_collection(spark, newer, run_ts="20260104T000000Z", **args)
    assert tuple(stats.first()) == (3, 4, 1)
    assert readers.read_seen(spark, state.seen).count() == 4


def test_stream_import(spark, lookup, tmp_path):
    state = jm.State(str(tmp_path / "state"))
    checkpoint = str(tmp_path / "checkpoint")

    def land(pages, run_ts):
        postings = collect.with_provenance(listings(spark, pages), "portal", run_ts)
        writers.land_raw(postings, state.landing, run_ts)

    land({1: "ab"}, "20260101T000000Z")
    start_incremental_import(spark, state, lookup, checkpoint).awaitTermination()
    assert readers.read_jobs(spark, state.jobs).count() == 2
    land({1: "bc"}, "20260102T000000Z")
    start_incremental_import(spark, state, lookup, checkpoint).awaitTermination()
    assert readers.read_jobs(spark, state.jobs).count() == 3


def test_stream_does_not_depend_on_batches(spark, lookup, tmp_path):
    """One address landed twice with another title, and rejected rows in two files: one file per batch or all at once."""
    results = []
    for files in (1, 1000):
        state = jm.State(str(tmp_path / f"state{files}"))
        for day, title in (("20260101", "Nurse"), ("20260102", "Staff Nurse")):
            rows = [
                (1, 0, title, "ACME", "https://x/1"), (1, 1, "Welder", "ACME", f"https://x/{title}"),
                (1, 2, "Cook", None, f"https://x/cook/{day}"),
            ]
            df = spark.createDataFrame(rows, "page long, pos int, job_title string, company string, job_url string")
            stamp = f"{day}T000000Z"
            writers.land_raw(collect.with_provenance(df.coalesce(1), "portal", stamp), state.landing, stamp)
        start_incremental_import(spark, state, lookup, str(tmp_path / f"check{files}"), files_per_batch=files).awaitTermination()
        jobs = readers.read_jobs(spark, state.jobs).select("job_title", "company").collect()
        rejected = spark.read.parquet(state.rejected).select("job_url").collect()
        results.append((sorted(map(tuple, jobs)), sorted(map(tuple, rejected))))
    assert results[0] == results[1]
    assert [r[0].lower() for r in results[0][0]] == ["nurse", "welder"]
    assert len(results[0][1]) == 2


def test_repeated_import_replaces_its_rejects(spark, lookup, tmp_path):
    state = jm.State(str(tmp_path / "state"))
    df = spark.createDataFrame([("Cook", None, "u")], "job_title string, company string, job_url string")
    raw = collect.with_provenance(df.withColumn("file_name", F.lit("f")).withColumn("ord", F.lit(0)), "p", "20260101T000000Z")
    clean = jm.run_clean(raw, lookup, state, csv=False)
    for run_id in ("a", "a", "b"):
        jm.run_import(clean, state, run_id)
    assert spark.read.parquet(state.rejected).count() == 2


def test_amount_too_large_is_rejected(spark):
    from jobmarket.functions.salary import normalize_salary, parse_salary
    from jobmarket.operators.upsert import accepted_row

    df = spark.createDataFrame([("9" * 20 + " monthly",), ("9" * 30 + " monthly",), ("100 monthly",)], "s string")
    df = normalize_salary(parse_salary(df, F.col("s"))).withColumn("job_title", F.lit("t")).withColumn("company", F.lit("c"))
    kept = {len(r.s): r.salary_amount for r in df.where(accepted_row()).collect()}
    assert 28 in kept and kept[28] is not None and 38 not in kept


def test_table_of_an_earlier_release(spark, tmp_path):
    """The newest complete version is read, and adopted by the first import."""
    root = str(tmp_path / "t")
    assert latest_version(spark, root) is None and readers.read_jobs(spark, root).count() == 0
    old = spark.createDataFrame([(5, "A", "X", "c", "l", 9)], "id long, job_title string, career_category string, company string, location string, salary_min int")
    old.write.parquet(f"{root}/version=00000001")
    (tmp_path / "t" / "version=00000002").mkdir()
    assert latest_version(spark, root).endswith("00000001") and readers.read_jobs(spark, root).first().salary_min == 9
    new = {f.name: None for f in jm.schemas.CLEAN} | {"job_title": "B", "career_category": "X", "company": "c", "location": "l"}
    batch = spark.createDataFrame([tuple(new.values())], jm.schemas.CLEAN)
    assert import_jobs(batch, root) == (1, 2)
    rows = readers.read_jobs(spark, root).collect()
    assert {(r.job_title, r.id, r.salary_min) for r in rows} == {("A", 5, 9), ("B", 6, None)}


def test_landings_equal_the_whole_history(spark, lookup, tmp_path):
    """Random landings, cleaned one by one, against cleaning and importing all of them with every run."""
    rng = random.Random(3)
    one, full = jm.State(str(tmp_path / "one")), jm.State(str(tmp_path / "full"))
    titles = ["NURSE", "Nurse", "Welder", "zzz", "", "Sales Associate - x"]
    for run in range(4):
        rows = []
        for pos in range(rng.randrange(1, 25)):
            url = rng.choice(["", None, *[f"https://x/{i}?q={rng.randrange(3)}" for i in range(12)]])
            rows.append((run, pos, rng.choice(titles), rng.choice(["ACME", "Globex", None]), rng.choice(["Makati", "EUROPE", None]), rng.choice(["P15,000", "600", "x", None]), url))
        df = spark.createDataFrame(rows, "page long, pos int, job_title string, company string, location string, salary_text string, job_url string")
        stamp = f"2026010{run}T000000Z"
        collected = rng.choice(["2026-01-05T00:00:00+00:00", "2026-01-03T00:00:00+00:00", f"2026-01-0{run + 1}T00:00:00+00:00"])
        for state in (one, full):
            writers.land_raw(collect.with_provenance(df, "portal", collected), state.landing, stamp)
        stats = [tuple(jm.run_landing(spark, lookup, one, stamp).first())]
        if run == 2:  # a repeated run changes nothing, and one with nothing new is no harm
            writers.land_raw(collect.with_provenance(df, "portal", collected), one.landing, "20260102T010000Z")
            writers.land_raw(collect.with_provenance(df, "portal", collected), full.landing, "20260102T010000Z")
            assert tuple(jm.run_landing(spark, lookup, one, "20260102T010000Z").first())[2] == 0
            assert tuple(jm.run_landing(spark, lookup, one, stamp).first())[2] == 0
        clean = jm.run_clean(readers.read_landing(spark, full.landing), lookup, full, readers.LANDING_ORDER, csv=False)
        stats.append(tuple(jm.run_import(clean, full, stamp).first()))
        assert stats[0] == stats[1]
        tables = [readers.read_jobs(spark, s.jobs).drop("created_at") for s in (one, full)]
        assert sorted(map(repr, tables[0].select(sorted(tables[0].columns)).collect())) == sorted(map(repr, tables[1].select(sorted(tables[1].columns)).collect()))
        assert sorted(map(repr, jm.clean_table(spark, one).collect())) == sorted(map(repr, clean.select(jm.clean_table(spark, one).columns).collect()))
        report = {k: v for k, v in spark.read.json(full.report).first().asDict().items() if k != "generated_at"}
        assert jm.report_table(spark, one).first().asDict() == report
    ranked = [tuple(r) for r in jm.uncategorized_table(spark, one).collect()]
    assert ranked == sorted(ranked, key=lambda r: (-r[1], r[0])) and ranked


def test_landing_reads_only_the_key_files_it_may_meet(spark, lookup, tmp_path):
    state = jm.State(str(tmp_path / "state"))
    args = dict(lookup=lookup, state=state, source="portal")
    jm.run_collection(spark, listings(spark, {1: [str(i) for i in range(300)]}), run_ts="20260101T000000Z", **args)
    rows = spark.createDataFrame([("https://j/new",)], "dedup_key string")
    found = plans_run.stored_keys(spark, state, rows, "none")
    assert len(found.inputFiles()) > 100 and found.count() < 20


def test_place_tables_keep_codes_as_text(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_bytes("id,code,description\n1,012345000,Peñablanca\n".encode("cp1252"))
    assert tuple(readers.read_psgc(spark, str(path)).drop("ord").first()) == ("012345000", "Peñablanca")


def test_an_import_works_its_batch_out_once(spark, lookup, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def count(title):
        seen.add(1)
        return title

    rows = [{"job_title": "Nurse", "company": f"c{i}" if i else None, "job_url": f"u{i}", "source": "p", "collected_at": "2026-01-01T00:00:00+00:00"} for i in range(4)]
    data = [tuple(r.get(f.name) for f in jm.schemas.RAW) for r in rows]
    raw = spark.createDataFrame(data, jm.schemas.RAW).withColumns({"page": F.lit(1), "pos": F.lit(1), "run_ts": F.lit("1"), "landed_from": F.lit("p")})
    clean = jm.prepare(jm.clean_records(raw, lookup))
    counted = clean.withColumn("job_title", F.udf(count).asNondeterministic()("job_title"))
    state = jm.State(str(tmp_path / "state"))
    assert tuple(jm.run_import(counted, state, "a").first()) == (0, 3, 3)
    assert spark.read.parquet(state.rejected).count() == 1 and seen.value == 4

    prepared = []
    prepare = plans_run.prepare
    monkeypatch.setattr(plans_run, "prepare", lambda rows: prepared.append(rows) or prepare(rows))
    other = jm.State(str(tmp_path / "other"))
    assert tuple(jm.import_landing(raw, lookup, other, "1").first()) == (0, 3, 3)
    assert len(prepared) == 1 and jm.clean_table(spark, other).count() == 4
