from pyspark.sql import functions as F

from jobmarket.operators.skew import count_keys, hot_keys, lookup_join


def test_hot_keys_are_split_off(spark):
    rows = [("hot", i) for i in range(500)] + [("gone", i) for i in range(200)] + [(None, 0)] * 50
    rows += [(f"k{i % 120}", i) for i in range(600)]
    facts = spark.createDataFrame(rows, "key string, v int")
    dim = spark.createDataFrame([("hot", 1, "a"), *[(f"k{i}", i, None) for i in range(60)]], "key string, n int, s string")
    assert sorted(r.key for r in hot_keys(count_keys(facts, "key"), "key").collect()) == ["gone", "hot"]
    got = lookup_join(facts, dim, "key")
    plain = facts.join(dim, "key", "left").select("key", "v", "n", "s")
    assert got.columns == plain.columns
    assert got.exceptAll(plain).count() == plain.exceptAll(got).count() == 0


def test_no_partition_gets_a_third(spark):
    facts = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), "id"
    )
    dim = spark.range(30000).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("n"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = lookup_join(facts, dim, "key")
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 30000 and max(sizes) < 9000  # 7500 on average over four


def test_address_on_a_third_of_the_pages(spark):
    """No task of the search for new listings gets much more than its share, and the page flags are right."""
    from jobmarket.operators import collect

    rows = [(p, 0, "everywhere") for p in range(0, 9000, 3)] + [(p, 1, f"u{p}") for p in range(9000)]
    listings = spark.createDataFrame(rows, "page long, pos int, job_url string")
    seen = spark.createDataFrame([(f"u{p}",) for p in range(0, 9000, 2)], "job_url string")
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        new = only = collect.only_unseen(listings, seen)
        unseen = sorted(r[1] for r in new.groupBy(F.spark_partition_id()).count().collect())
        assert only.count() == 3000 + 4500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert unseen[-1] < 2 * unseen[len(unseen) // 2]
    flags = {r.page: r for r in collect.page_statistics(listings, seen).collect()}
    assert (flags[0].new_listings, flags[3].listings, flags[3].new_listings, flags[1].new_listings, flags[2].new_listings) == (1, 2, 1, 1, 0)
