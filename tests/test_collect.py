import random

from jobmarket import collect_new, crawl_stop, merge_details, only_unseen, page_statistics, union_seen, with_provenance


def listing(spark, pages):
    rows = [(p, i, u) for p, urls in pages.items() for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page bigint, pos int, job_url string")


def history(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "job_url string")


def crawl(pages, seen):
    """Page after page, as a person would read them."""
    kept, before = [], set()
    for page in sorted(pages):
        urls = [u for u in pages[page] if u]
        if not pages[page] or (urls and set(urls) <= before) or (seen and set(urls) <= seen):
            return kept, page
        kept += [(page, i, u) for i, u in enumerate(pages[page]) if u and u not in before and u not in seen]
        before |= set(urls)
    return kept, None


def both(spark, pages, seen, fetched=None):
    df, hist = listing(spark, pages), history(spark, seen)
    got = sorted(tuple(r) for r in collect_new(df, hist, pages=fetched).collect())
    return got, crawl_stop(df, hist, pages=fetched).first()[0]


def test_stall_and_history(spark):
    pages = {1: ["a", "b"], 2: ["b", "c", "c"], 3: ["a", "c"], 4: ["z"]}
    assert both(spark, pages, set()) == ([(1, 0, "a"), (1, 1, "b"), (2, 1, "c"), (2, 2, "c")], 3)
    assert both(spark, pages, {"b", "c"}) == ([(1, 0, "a")], 2)


def test_empty_page_stops(spark):
    fetched = spark.createDataFrame([(p,) for p in (1, 2, 3)], "page bigint")
    assert both(spark, {1: ["a"], 3: ["b"]}, set(), fetched) == ([(1, 0, "a")], 2)


def test_options(spark):
    df = listing(spark, {1: ["a"], 2: ["b"], 3: ["c"]})
    seen = history(spark, ["a"])
    assert collect_new(df, seen).count() == 0
    assert collect_new(df, seen, incremental=False).count() == 3
    assert collect_new(df, seen, incremental=False, max_pages=2).count() == 2


def test_random_crawls(spark):
    rng = random.Random(3)
    for _ in range(6):
        urls = [f"u{i}" for i in range(12)]
        pages = {p: [rng.choice([*urls, None]) for _ in range(rng.randint(1, 4))] for p in range(8)}
        seen = {u for u in urls if rng.random() < 0.2}
        assert both(spark, pages, seen) == (lambda k: (sorted(k[0]), k[1]))(crawl(pages, seen))


def test_seen_and_statistics(spark):
    df = listing(spark, {1: ["a", "b", "b"], 2: ["b", "c", None]})
    seen = history(spark, ["a"])
    assert sorted(r.job_url for r in only_unseen(df, seen).collect()) == ["b", "b", "b", "c"]
    assert sorted(tuple(r) for r in page_statistics(df, seen).collect()) == [(1, 3, 2), (2, 3, 1)]
    assert sorted(r[0] for r in union_seen(seen, df).collect()) == ["a", "b", "c"]


def test_details_and_provenance(spark):
    df = spark.createDataFrame([("a", "t", "x"), ("b", "t", "y")], "job_url string, job_title string, location string")
    details = spark.createDataFrame([("a", "", "new", "d")], "job_url string, job_title string, location string, description string")
    rows = {r.job_url: r for r in merge_details(df, details).collect()}
    assert (rows["a"].job_title, rows["a"].location, rows["a"].description) == ("t", "new", "d")
    assert (rows["b"].job_title, rows["b"].location, rows["b"].description) == ("t", "y", None)
    row = with_provenance(df, "portal", "2026-01-01T00:00:00+00:00", "https://b").first()
    assert (row.source, row.source_url, row.collected_at, row.salary) == ("portal", "https://b", "2026-01-01T00:00:00+00:00", None)


def test_crawl_reads_its_listings_few_times(spark):
    df, seen = listing(spark, {1: ["a"]}), history(spark, ["b"])
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/crawl-plan")
    plan = collect_new(spark.read.parquet(path), seen)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 6
