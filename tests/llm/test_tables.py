"""Vectors, pages and the pipeline against brute force."""

import gzip
import hashlib
import math
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from jobmarket.llm import multiindex, warc  # noqa: E402
from jobmarket.llm.common import work_path  # noqa: E402
from jobmarket.llm.registry import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_search_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = sorted((r.vec_id, r.embedding) for r in rows.collect())
    ids, vectors = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    got = {}
    for r in multiindex.search(rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    hits = 0
    for query, found in got.items():
        q = vectors[ids == query][0]
        cosines = (vectors * q).sum(1) / np.sqrt((vectors**2).sum(1) * (q * q).sum())
        cosines[ids == query] = -2
        best = ids[np.lexsort((ids, -cosines))[:5]].tolist()
        found.sort()
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5] and found == sorted(found, key=lambda x: (-x[2], x[1]))
        assert all(abs(cosines[ids == v][0] - s) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best))
    assert hits >= 0.9 * 5 * len(got)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [nan, 1.0, 0.0]),
        (6, [inf, 1.0, 0.0]), (7, [1.0, None, 0.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (9, [4.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS block", "2 AS v", "3 AS label")
    got = [tuple(r)[:3] for r in multiindex.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 9), (0, 3, 2), (0, 4, 50), (50, 1, 2), (50, 2, 0), (50, 3, 1), (50, 4, 9)]
    assert multiindex.search(df.limit(0)).count() == 0


def test_search_compares_only_codes_it_retrieves(monkeypatch):
    """A query in a tight cluster ends early, and codes of the other clusters are never looked at."""
    rng = np.random.default_rng(4)
    vectors = np.repeat(rng.normal(size=(40, 64)), 50, axis=0) + rng.normal(scale=0.01, size=(2000, 64))
    index = multiindex.MultiIndex(np.arange(2000), vectors, multiindex.learn_rotation(vectors))
    looked, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: looked.append(np.size(x)) or count(x))
    ids, scores = index.search(7, vectors[7], 5)
    cosines = vectors @ vectors[7] / np.linalg.norm(vectors, axis=1) / np.linalg.norm(vectors[7])
    cosines[7] = -2
    assert ids.tolist() == np.argsort(-cosines)[:5].tolist() and np.allclose(scores, np.sort(cosines)[::-1][:5])
    assert 0 < sum(looked) < 1000


@pytest.fixture(scope="module")
def pages(spark):
    big = "".join(f"<p>{i * i}</p>" for i in range(40_000))
    rows = [
        (3, "http://a/3", "y" * 100), (1, "http://a/1", "y" * 100), (2, None, "y" * 99), (4, "http://a/4", "y" * 99), (5, "u", None), (6, "u", ""),
        (7, "http://a/ü\r\nX: y", "é" * 50), (8, "u", "é" * 50), (9, "u", big), (10, "u", big), (10, "u", big), (None, "u", "z" * 200), (11, "u", "z" * 200),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS shard", "2 AS kind")


@pytest.mark.parametrize("sizes", [(warc.SHARD_BYTES, warc.FILE_BYTES), (2000, 400)])
def test_warc(spark, pages, sizes):
    root = work_path(spark)
    manifest = warc.write_warc(pages, root, *sizes)
    rows = pages.select("page_id", "html").collect()
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(r.page_id, first.get(r.html or "", r.page_id))
    want = []
    for r in rows:
        payload = (r.html or "").encode()
        refers = first[r.html or ""] if len(payload) >= 100 and r.page_id != first[r.html or ""] else None
        kind = "response" if refers is None else "revisit"
        want.append((r.page_id, len(payload), hashlib.sha256(payload).hexdigest(), kind, refers, payload if refers is None else b""))
    got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.read_warc(manifest, root).drop("url").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    folder = Path(root.removeprefix("file:"))
    listed = {r.file: r for r in manifest.collect()}
    there = {p.name: p for p in folder.glob("*.warc.gz")}
    assert set(listed) == set(there) and not list(folder.glob("_temporary*"))
    assert (len(there) > 3) == (sizes[0] == 2000)
    for name, path in there.items():
        data = path.read_bytes()
        assert hashlib.sha256(data).hexdigest() == listed[name].sha256 and len(data) == listed[name].bytes
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") == listed[name].records + 1


def test_warc_is_deterministic(spark, pages):
    sums = []
    for df in (pages, pages.repartition(5)):
        manifest = warc.write_warc(df, work_path(spark), 2000, 400)
        sums.append(sorted((r.file, r.sha256) for r in manifest.collect()))
    assert sums[0] == sums[1]


def test_warc_of_no_pages(spark, pages):
    root = work_path(spark)
    manifest = warc.write_warc(pages.limit(0), root)
    assert manifest.count() == 0 and warc.read_warc(manifest, root).count() == 0


def brute_force_pipeline(rows, rejected):
    """(doc_id, text) of every row the pipeline's mix holds, from (doc_id, text, source)."""
    from test_jaccard import kept

    rows = [r for r in rows if r[0] not in rejected]
    left = set(kept([(d, t) for d, t, _ in rows if d is not None]))
    rows = [r for r in rows if r[0] is None or r[0] in left]
    words = [(d, (t or "").encode().split()) for d, t, _ in rows]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - 12):
                key = tuple(w[i : i + 13])
                first[key] = min(d, first.get(key, d))
    texts = []
    for d, w in words:
        gone = {j for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        texts.append([x for j, x in enumerate(w) if j not in gone] if gone else None)
    sources = Counter(s for *_, s in rows)
    out = []
    for (d, t, s), changed in zip(rows, texts):
        rate = len(rows) / len(sources) / sources[s]
        parts = max(1, math.ceil(rate / 16))
        cdf = np.cumsum([math.exp(-rate / parts) * (rate / parts) ** k / math.factorial(k) for k in range(101)])
        name = "null" if d is None else str(d)
        draws = [int(hashlib.md5(f"mix:{name}:{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in range(1, parts + 1)]
        text = (t or "") if changed is None else b" ".join(changed).decode()
        out += [(d, text)] * sum(int((cdf <= u).sum()) for u in draws)
    return out


def pipeline_rows(spark, sf):
    from jobmarket.llm import toxicity

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rejected = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.predicted}
    return brute_force_pipeline([(r.doc_id, r.text, r.source) for r in docs.collect()], rejected)


def test_pipeline(spark):
    from jobmarket.llm.bpe import Encoder, default_path

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    encoder, want = Encoder(default_path()), pipeline_rows(spark, SF)
    ids = encoder.encode_all([t for _, t in want])
    got = [(r.doc_id, r.n_tokens, list(r.ids), r.decoded) for r in out.collect()]
    assert sorted(got) == sorted((d, len(i), i, encoder.decode(i)) for (d, _), i in zip(want, ids))


def test_pipeline_edges(spark, tmp_path):
    """Null and empty texts and ids, repeated rows, columns with the operators' own names, and an empty table."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [
        (None, "no id " + passage, "a"), (1, None, "a"), (2, "", "b"), (3, " \t\n", None), (4, passage, "b"), (5, "start " + passage + " end", "b"),
        (5, "start " + passage + " end", "b"), (6, "one two", None), (7, "One  two", "c"), (8, "x " * 20_000, "c"),
    ]
    names = "copies copy shuffle_key found kept mark node size root component_id score n_words rate key".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'en' AS lang", "1L AS n_chars", *[f"'?{n}' AS {n}" for n in names])
    labels = spark.createDataFrame([(4, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for name, df, want in (("some", docs, rows), ("none", docs.limit(0), [])):
        sf = str(tmp_path / name)
        df.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        stage = df
        for step, run in corpus_pipeline.STAGES[:-1]:
            stage = run(spark, stage, sf)
            assert stage.columns == df.columns, step
        assert all(r[n] == f"?{n}" for r in stage.collect() for n in names)
        got = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens").collect()
        assert Counter(r.doc_id for r in got) == Counter(d for d, _ in brute_force_pipeline(want, set()))


def test_queries_are_complete():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
