"""Near duplicates of the corpus pipeline against brute-force Jaccard similarity."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from jobmarket.llm import jaccard


def shingled(text):
    tokens = (text or "").encode().lower().split()
    return frozenset(tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))) if tokens else frozenset()


def kept(rows):
    """Ids left by brute force: the smallest of every component."""
    sets, parent = {}, {}
    for doc, text in rows:
        sets[doc] = shingled(text)
        parent[doc] = doc

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                high, low = sorted((root(a), root(b)), reverse=True)
                parent[high] = low
    return sorted(d for d in sets if root(d) == d)


def planted():
    """Texts with copies in which some words are changed: similarities from 1 down to about 0.5."""
    rng = random.Random(5)
    rows = []
    for size in (8, 40, 100, 400):
        for _ in range(12):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            rows.append(" ".join(words))
            for changes in (0, 1, 2, 3, size // 60, size // 40, size // 20):
                copy = list(words)
                for _ in range(changes):
                    copy[rng.randrange(size)] = f"x{rng.randrange(5000)}"
                rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate([*rows, None, "", " ", "one two", "One  Two", "one three"]))


@pytest.mark.parametrize("rounds", [jaccard.ROUNDS, 1])
def test_near_duplicates_of_the_pipeline_are_complete(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)
    repeated = docs.unionAll(docs.limit(5)).unionAll(spark.createDataFrame([(None, rows[0][1])], docs.schema))
    again = corpus_pipeline.near_duplicates(spark, repeated, "").select("doc_id").distinct().collect()
    assert sorted(r.doc_id for r in again if r.doc_id is not None) == kept(rows) and None in {r.doc_id for r in again}


def test_no_near_duplicates(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 0


def test_large_group_below_the_threshold(spark, monkeypatch):
    """Hundreds of texts that share keys but are mostly 0.5 to 0.75 alike, and some near copies among them."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(400):
        words = list(base)
        for _ in range(rng.randrange(8, 14)):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(words))
        if rng.random() < 0.1:
            words[rng.randrange(300)] = "y"
            rows.append(" ".join(words))
    rows = list(enumerate(rows))
    compared = []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets: compared.append(pairs.count()) or verified(pairs, sets))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'?' AS node", "'?' AS key", "'?' AS size", "'?' AS root")
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)
    assert len(compared) == jaccard.ROUNDS + 1 and compared[-1] < len(rows) * (len(rows) - 1) / 2


def test_fingerprints_connect_copies(spark):
    """Copies with few changes are linked by their fingerprints alone, and texts that are unlike are not."""
    rng = random.Random(3)
    long = [" ".join(f"w{rng.randrange(5000)}" for _ in range(3000)) for _ in range(20)]
    rows = list(enumerate([*long, *(t + " end" for t in long[:10]), None, "", "few words"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    schema = "doc_id long, node long, size long, keys array<long>, fp long"
    signed = docs.mapInArrow(jaccard._signatures, schema).withColumn("keys", F.expr("slice(keys, 1, 0)"))  # nothing for MinHash
    named = {r.node: r.doc_id for r in signed.collect()}
    got = jaccard.links(docs, signed.drop("doc_id").dropDuplicates(["node"])).collect()
    near = {frozenset((a, a + 20)) for a in range(10)}
    alike = {frozenset((a, a + 20)) for a in range(10) if bin(simprint(rows[a][1]) ^ simprint(rows[a + 20][1])).count("1") <= jaccard.RADIUS}
    assert {frozenset((named[r.a], named[r.b])) for r in got} == alike and alike and alike <= near


def simprint(text):
    return jaccard.simhash.majority(jaccard.shingles(text))
