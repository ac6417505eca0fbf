"""Operators on documents against brute force: a table of edge cases, an empty table, and the smallest data set."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from jobmarket.llm import bpe, common, contexttree, mixing, orderhash, sharding, simhash, substrings, toxicity

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"w{i}" for i in range(40))
#: null ids and texts, empty and blank texts, ties, repeated rows, a very long text, other alphabets
EDGES = [
    (None, "no id here", "a"), (None, PASSAGE, None), (1, None, "a"), (2, "", "a"), (3, " \t\r\n\x0b\x0c ", "b"),
    (4, "One Two", "b"), (5, "one two", "b"), (6, PASSAGE, "a"), (7, f"before {PASSAGE} after", "a"), (7, f"before {PASSAGE} after", "a"),
    (8, PASSAGE.upper(), None), (9, "x " * 60_000 + PASSAGE, "a"), (10, "Ünï çödé 日本 🙂  <|endoftext|> don't", "c"), (10, "other text, same id", "c"),
]


@pytest.fixture(scope="module")
def edges(spark):
    """With extra columns whose names operators use inside or for their results."""
    df = spark.createDataFrame(EDGES, "doc_id long, text string, source string")
    return df.selectExpr("*", "'en' AS lang", "1L AS n_chars", *[f"'?' AS {n}" for n in ("fp", "mark", "found", "kept", "hot", "copies", "copy", "shard", "size", "code", "score", "word")])


@pytest.fixture(scope="module")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


def split(text):
    return (text or "").encode().split()


# ------------------------------------------------------------------------- mixing


def test_a_rare_source_is_drawn_in_pieces(spark, monkeypatch):
    """One document against thousands, twice in the table: dealt out, it gets the copies that one row would draw."""
    common = spark.range(6000).selectExpr("id AS doc_id", "'x' AS text", "'many' AS source")
    rare = spark.createDataFrame([(-1, "rare", "few"), (-1, "rare again", "few"), (None, "no id", None)], "doc_id long, text string, source string")
    docs = common.unionAll(rare).selectExpr("*", "'?' AS copies", "'?' AS copy")
    mixed = []
    for piece in (4, 10**6):
        monkeypatch.setattr(mixing, "PIECE", piece)
        rows = mixing.mix(docs).where("source <> 'many' OR source IS NULL")
        mixed.append(sorted((tuple(r) for r in rows.select("text", "source", "copies", "copy", "shuffle_key").collect()), key=repr))
    assert mixed[0] == mixed[1]
    for text in ("rare", "rare again", "no id"):
        copies = [r[2:4] for r in mixed[0] if r[0] == text]
        assert sorted(c for _, c in copies) == list(range(1, len(copies) + 1)) and {n for n, _ in copies} == {len(copies)}
    assert 900 < sum(r[0] == "rare" for r in mixed[0]) < 1100 and 1800 < sum(r[0] == "no id" for r in mixed[0]) < 2200


def test_mix_comes_in_order(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'x' AS text", "'s' || (id % 3) AS source")
    keys = [r.shuffle_key for r in mixing.mix(docs).select("shuffle_key").collect()]
    assert keys == sorted(keys) and mixing.mix(docs).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------------ SimHash


def plain_fingerprint(text, words=3):
    tokens = split((text or "").encode().lower().decode())
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for doc, f in rows:
        if doc is not None:
            least[root(f)] = min(doc, least.get(root(f), doc))
    return sorted(((d, f"{f:016x}", least.get(root(f))) for d, f in rows), key=repr)


@pytest.mark.parametrize("pairwise", [simhash.PAIRWISE, 1])
def test_simhash(edges, texts, documents, monkeypatch, pairwise):
    """With pairwise = 1 every shared key is hot, and all links come from meeting points."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    for df, rows in ((edges, [(d, t) for d, t, _ in EDGES]), (documents, texts)):
        got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
        assert sorted(got, key=repr) == plain_components([(d, plain_fingerprint(t)) for d, t in rows])


def test_simhash_links_are_complete(spark):
    base = 0x0123456789ABCDEF
    prints = {base} | {base ^ (1 << i) for i in range(0, 64, 3)} | {base ^ (1 << i) ^ (1 << 63 - i) ^ (1 << 31) for i in range(5)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    for most in (1, 128):
        simhash.PAIRWISE = most
        links = [(a % 2**64, b % 2**64) for a, b in simhash.links(df).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        groups = plain_components([(x, x) for x in prints])
        found = {x: {x} for x in prints}
        for a, b in links:
            whole = found[a] | found[b]
            for x in whole:
                found[x] = whole
        assert sorted((x, f"{x:016x}", min(s)) for x, s in found.items()) == sorted(groups)
    simhash.PAIRWISE = 128


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_thresholds_fulfil_the_pigeonhole(radius):
    import numpy as np

    rng = np.random.default_rng(radius)
    bits = rng.random((500, 64)) < rng.random(64)
    bits[:, 1] = bits[:, 0]
    cells = np.append((bits.T.astype(float) @ bits).ravel(), len(bits))
    parts = simhash.plan(cells, radius)
    assert sorted(b for group, _ in parts for b in group) == list(range(64))
    assert sum(t for _, t in parts) == radius - len(parts) + 1
    assert any({0, 1} <= set(group) for group, _ in parts)


def test_keep_one(edges, empty):
    kept = sorted((r.doc_id for r in simhash.keep_one(edges).collect() if r.doc_id is not None))
    assert kept == sorted(set(kept) | {7}) or kept.count(7) in (0, 2)
    assert simhash.keep_one(edges).columns == edges.columns and {1, 4} <= set(kept) and not {2, 3, 5} & set(kept)
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    from jobmarket.llm.common import components

    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_small_steps(spark, monkeypatch):
    """Each star is a step of its own, as the driver holds whole plans; pairs that are stars need no step."""
    stored = []

    def counted(df, path=None, staged=common.staged):
        stored.append(df._jdf.queryExecution().executedPlan().toString().count(" Exchange"))
        return staged(df, path)

    monkeypatch.setattr(common, "staged", counted)
    components = common.components
    chain = [(i, i + 1) for i in range(20)]
    assert {r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}
    assert max(stored) <= 5
    stored.clear()
    stars = [(i % 3, i) for i in range(3, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {i: i % 3 for i in range(40)} and len(stored) == 1


# ------------------------------------------------------------------- order MinHash


def test_order_minhash(edges, empty, texts, documents):
    for df, rows in ((documents, texts), (edges, [(d, t or "") for d, t, _ in EDGES])):
        got = orderhash.fingerprints(df).collect()
        assert len(got) == len(rows)
        # descending doc_id, repeated ids by text, rows without id last; after the last comes the first
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
        want = Counter()
        for i, (doc, text) in enumerate(order):
            half = len(text) // 2
            edited = text[: len(text) - half] + order[(i + 1) % len(order)][1][:half]
            want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = defaultdict(set)
    for r in orderhash.fingerprints(documents).collect():
        same[dict(texts)[r.doc_id]].add(r.fingerprint)
    assert max(map(len, same.values())) == 1
    assert orderhash.fingerprints(empty).count() == 0


def plain_signature(text):
    """Order MinHash over a dictionary of k-mers, one number at a time."""
    top = (1 << 64) - 1
    mixed = lambda x: (lambda y: y ^ y >> 33)((lambda y: (y ^ y >> 33) * 0xC4CEB9FE1A85EC53 & top)((x ^ x >> 33) * 0xFF51AFD7ED558CCD & top))
    k = min(10, len(text))
    seen, bins = Counter(), defaultdict(list)
    for i in range(len(text) - k + 1 if text else 0):
        kmer = text[i : i + k]
        h = mixed(sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, c in enumerate(kmer)) & top)
        value = mixed((h + seen[kmer] * 0xC2B2AE3D27D4EB4F) & top)
        seen[kmer] += 1
        bins[value >> 58].append((value << 6 & top, i, h))
    out = [0] * 64
    for b, found in bins.items():
        folded = 0
        for place, (_, _, h) in enumerate(sorted(sorted(found)[:2], key=lambda x: x[1]), 1):
            folded = mixed((folded * 0xC2B2AE3D27D4EB4F + h + place) & top)
        out[b] = folded % 65_535 + 1
    return out


def test_signature_against_plain_order_minhash(texts):
    for text in [t for _, t in texts[:25]] + ["", "a", "ab" * 400, "日本 🙂 " * 70, "x" * 2000]:
        text = text[:3000]
        assert orderhash.signature(orderhash._points(text)).tolist() == plain_signature(text)


def test_order_matters_and_repeats_count():
    points = lambda t: orderhash.signature(orderhash._points(t))
    words = [f"word{i * i}" for i in range(300)]
    text = " ".join(words)
    moved = " ".join(words[150:] + words[:150])
    edited = text.replace("word100 ", "ward100 ")
    alike = lambda a, b: orderhash.likeness(points(a), points(b))
    assert alike(text, text) == 1 == alike("", "") and alike("", text) == 0
    assert alike(text, edited) > 0.8 > alike(text, moved)
    assert alike("ab" * 50, "ab" * 500) < 1


# ------------------------------------------------------------------------- sharding


def test_sharding(edges, empty, texts, documents):
    for df, rows in ((edges, [(d, t) for d, t, _ in EDGES]), (documents, texts)):
        for shards in (1, 7, 40):
            got = sharding.shard_rows(df, shards).collect()
            assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
                (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows
            )
            slots = defaultdict(list)
            for r in got:
                slots[r.shard].append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
            sizes = [len(slots[s]) for s in range(shards)]
            assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert sharding.shard_rows(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    got = {r.id: r.p for r in spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("p")).collect()}
    assert sorted(got.values()) == list(range(n))
    assert all(sharding.locate(i, n, 4) == (p % 4, p // 4) for i, p in got.items())


# --------------------------------------------------------------------------- mixing


def test_mixing(edges, empty):
    mixed = mixing.mix(edges)
    assert mixed.columns == [c for c in edges.columns if c not in ("copies", "copy")] + ["copies", "copy", "shuffle_key"]
    rows = mixed.collect()
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    for key, group in Counter((r.doc_id, r.text, r.copies) for r in rows).items():
        assert group % key[2] == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(edges, {"a": 1.0}).where("source <> 'a' OR source IS NULL").count() == 0
    assert mixing.mix(edges, {}).count() == 0


def test_mixing_meets_its_weights_with_large_rates(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "IF(id < 40, 'small', 'large') AS source")
    n = {r.source: r["count"] for r in mixing.mix(df, {"small": 3.0, "large": 1.0}).groupBy("source").count().collect()}
    assert abs(n["small"] - 3000) < 5 * 55 and abs(n["large"] - 1000) < 5 * 32  # rates 75 and 0.25
    again = mixing.mix(df, {"small": 3.0, "large": 1.0}).count()
    assert again == sum(n.values())


# ------------------------------------------------------------------------------ BPE


def test_bpe(edges, empty, texts, documents):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_path())
    for df, rows in ((edges, [(d, t or "") for d, t, _ in EDGES]), (documents, texts)):
        want = Counter()
        for doc, text in rows:
            ids = reference.encode(text, add_special_tokens=False).ids
            want[doc, tuple(ids), reference.decode(ids, skip_special_tokens=False)] += 1
        got = bpe.encode(df, decoded=True, digests=True).collect()
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
        for r in got:
            assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
    assert bpe.encode(empty).count() == 0


def test_bpe_forgets_and_goes_on(texts, monkeypatch):
    plain = bpe.Encoder(bpe.default_path())
    want = plain.encode_all([t for _, t in texts[:40]])
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    small = bpe.Encoder(bpe.default_path())
    assert [small.encode_all([t])[0] for _, t in texts[:40]] == want


# ----------------------------------------------------------------------- substrings


def plain_dedup(rows):
    first = {}
    for doc, text in rows:
        words = split(text)
        for i in range(len(words) - 12):
            key = tuple(words[i : i + 13])
            if doc is not None:
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        words = split(text)
        gone = [False] * len(words)
        for i in range(len(words) - 12 if doc is not None else 0):
            if first[tuple(words[i : i + 13])] < doc:
                gone[i : i + 13] = [True] * 13
        out.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("shared, sent", [(substrings.SHARED, substrings.SENT_ANCHORS), (0, substrings.SENT_ANCHORS), (2, 0)])
def test_substrings(edges, empty, texts, documents, monkeypatch, shared, sent):
    """With shared = 0 every window is dealt out by its own hash; with sent = 0 anchors are joined to the documents."""
    monkeypatch.setattr(substrings, "SHARED", shared)
    monkeypatch.setattr(substrings, "SENT_ANCHORS", sent)
    for df, rows in ((edges, [(d, t) for d, t, _ in EDGES]), (documents, texts)):
        got = Counter(tuple(r) for r in substrings.dedup_substrings(df).collect())
        assert got == plain_dedup(rows)
    assert substrings.dedup_substrings(empty).count() == 0


def test_removed_repeats_keep_other_columns(edges):
    out = substrings.remove_repeats(edges)
    assert out.columns == edges.columns and out.count() == edges.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[3].text == EDGES[4][1] and rows[7].text == "before after" and rows[7].n_chars == 12 and rows[6].text == PASSAGE


# ------------------------------------------------------------------------- toxicity


def test_toxicity(edges, empty, documents, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(documents, labels)
    scored = toxicity.score(documents, model).collect()
    assert len(scored) == documents.count()
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    for r in scored:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    learnt = [(r.predicted, marked[r.doc_id]) for r in scored if r.doc_id in marked and not r.held_out]
    assert sum(p == t for p, t in learnt) > 0.9 * len(learnt)
    got = toxicity.score(edges, model).collect()
    assert len(got) == len(EDGES) and all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert toxicity.score(empty, model).count() == 0 == toxicity.keep_clean(empty, model).count()
    assert toxicity.keep_clean(edges, model).columns == edges.columns


def test_toxicity_without_examples(edges, spark):
    labels = spark.createDataFrame([(4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(edges, labels) is None
    assert {r.score for r in toxicity.score(edges, None).collect()} == {0.0}


def test_toxicity_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    found = toxicity.score(documents, toxicity.fit(documents, labels)).where("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) < 0.05 * n[0, 0] and n[1, 1] > 0.6 * (n[1, 1] + n.get((1, 0), 0))


# --------------------------------------------------------------------- context tree


def test_base_score(edges, empty, texts, documents, monkeypatch):
    for df, rows, share in ((edges, [(d, t) for d, t, _ in EDGES], 2), (documents, texts, contexttree.FREQUENT)):
        monkeypatch.setattr(contexttree, "FREQUENT", share)
        held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
        tokens = [[*split((t or "").encode().lower().decode()), None] for _, t in rows]
        counts = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
        total, kinds = sum(counts.values()), len(counts)
        want = Counter()
        for (doc, _), h, ws in zip(rows, held, tokens):
            base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
            want[doc, h, len(ws), sum(counts[w] > 0 for w in ws), total, round(base, 4)] += 1
        got = contexttree.score(df).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert contexttree.score(empty).count() == 0


def test_context_tree_against_recursion(spark):
    """Weights and probabilities of a small tree, by the textbook recursion."""
    train, probe = [b"abracadabra", b"abab"], b"abrx"
    counts = defaultdict(lambda: [0, 0])

    def steps(text):
        padded = b"\xff\xff" + text + b"\xff"
        for i in range(2, len(padded)):
            for b in range(8):
                node = (padded[i] >> (8 - b)) | (1 << b)
                yield padded[i - 2 : i], node, padded[i] >> (7 - b) & 1

    for text in train:
        for ctx, node, bit in steps(text):
            for d in range(3):
                counts[ctx[2 - d :], node][bit] += 1

    def own(key):
        a, b = counts[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, node):
        if len(ctx) == 2:
            return own((ctx, node))
        below = sum(weighted(c, n) for c, n in list(counts) if n == node and len(c) == len(ctx) + 1 and c.endswith(ctx))
        return math.log(0.5 * math.exp(own((ctx, node))) + 0.5 * math.exp(below))

    def p_one(ctx, node, d=0):
        key = (ctx[2 - d :], node)
        if key not in counts:
            return None
        a, b = counts[key]
        kt = (b + 0.5) / (a + b + 1)
        deeper = p_one(ctx, node, d + 1) if d < 2 else None
        if deeper is None:
            return kt
        stop = math.exp(own(key) - math.log(2) - weighted(*key))
        return stop * kt + (1 - stop) * deeper

    want = sum(math.log10(p if bit else 1 - p) for ctx, node, bit in steps(probe) for p in [p_one(ctx, node) or 0.5])
    docs = spark.createDataFrame([(t.decode(),) for t in train], "text string")
    levels, _ = contexttree.context_tree(docs, 2)
    model = contexttree.Model(*contexttree.frequent_nodes(levels), 2)
    assert model.whole and abs(model.score([probe])[0][0] - want) < 1e-5
    # and the same without a cache
    grams, _ = contexttree.grams([probe], 2)
    joined = contexttree.gram_scores(spark.createDataFrame([(int(g),) for g in set(grams.tolist())], "gram long"), levels).collect()
    assert {r.gram for r in joined} == set(grams.tolist()) and abs(sum(r.score * grams.tolist().count(r.gram) for r in joined) - want) < 1e-9
    whole = sum(10 ** model.score([bytes(x)])[0][0] for x in [b"", *([bytes([i]) for i in range(255)])])
    assert whole <= 1 + 1e-6


def test_context_seen_very_often_leaves_the_other_bit_possible(spark):
    """Counts (0, 1e8) at the first node without context: a byte below 128 is rare, not impossible."""
    n = 100_000_000
    levels = [spark.createDataFrame([(0, 1, (n + 0.5) / (n + 1.0), n)], "ctx long, node long, p double, n long")]
    model = contexttree.Model(*contexttree.frequent_nodes(levels), 0)
    import numpy as np

    assert abs(model.code_lengths(np.array([65]))[0][0] - (math.log10(0.5 / (n + 1.0)) + 7 * math.log10(0.5))) < 1e-6


def test_cache_keeps_the_most_frequent(spark):
    levels = [spark.createDataFrame([(0, i, 0.5, n) for i, n in enumerate([1, 1, 2, 3, 4, 9])], "ctx long, node long, p double, n long")]
    found = [contexttree.frequent_nodes(levels, most) for most in (6, 5, 4, 3, 2, 0)]
    assert [(len(keys), whole) for keys, _, whole in found] == [(6, True), (4, False), (4, False), (2, False), (2, False), (0, False)]


def test_cached_bytes_take_one_lookup(spark, monkeypatch):
    """A byte whose longest contexts are all cached costs one search, and scores as in the whole tree."""
    import numpy as np

    levels, _ = contexttree.context_tree(spark.createDataFrame([("abracadabra " * 9 + "xyz",)], "text string"), 2)
    whole, cut = (contexttree.Model(*contexttree.frequent_nodes(levels, most), 2) for most in (None, 90))
    grams = np.unique(contexttree.grams([b"abracadabra xyzq"], 2)[0])
    want, calls, search = whole.code_lengths(grams)[0], [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *args: (calls.append(1), search(*args))[1])
    got, exact = cut.code_lengths(grams)
    assert whole.whole and not cut.whole and len(calls) <= 1
    assert 5 < exact.sum() < len(grams) and got[exact].tolist() == want[exact].tolist()
    joined = {r.gram: r.score for r in contexttree.gram_scores(spark.createDataFrame([(int(g),) for g in grams], "gram long"), levels).collect()}
    assert all(abs(joined[g] - w) < 1e-9 for g, w in zip(grams.tolist(), want))


@pytest.mark.parametrize("most", [0, 300, 20_000])
def test_scores_do_not_depend_on_the_cache(spark, edges, documents, monkeypatch, most):
    """Contexts outside of the cache count in full."""
    docs = edges.select("doc_id", "text").unionAll(documents.select("doc_id", "text").limit(60))
    want = sorted(map(tuple, contexttree.score(docs).collect()), key=repr)
    monkeypatch.setattr(contexttree, "MAX_NODES", most)
    got = sorted(map(tuple, contexttree.score(docs).collect()), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))
