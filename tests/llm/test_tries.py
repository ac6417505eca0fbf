"""Source divergence, language ID and the prefix trie against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise
from math import log2

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobmarket.llm import divergence, langid, prefixtrie

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------ source divergence


def plain_audit(rows):
    """Rows of (lang, source, part, item, value, rank) of documents (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    groups, docs, counts = defaultdict(set), Counter(), defaultdict(Counter)
    for text, lang, source in rows:
        groups[lang].add(source)
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        docs.update((lang, t) for t in set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), n in docs.items() if g == lang and n >= 3]
        v = len(kept)
        of = {s: [counts[lang, s][t] for t in kept] for s in sources}
        all_of = [sum(c) for c in zip(*of.values())]
        p = {s: [1 + 10**9 * (c + 1) // (sum(n) + v) for c in n] for s, n in of.items()}
        q = [1 + 10**9 * (c + 1) // (sum(all_of) + v) for c in all_of]
        for s in sources:
            pairs = [(x, sum((a - b) ** 2 // b for a, b in zip(p[s], p[x]))) for x in sources - {s}]
            terms = [(t, (a - b) ** 2 // b) for t, n, a, b in zip(kept, of[s], p[s], q) if n and a > b]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, f, i + 1) for i, (t, f) in enumerate(items) if part == "pair" or i < 200]
    return sorted(out)


WORDS = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
AUDITED = [
    ("One two-TWO three, Été", "en", "a"), ("one two été", "en", "b"), ("one TWO", "en", "b"), ("one three été", "en", None), ("two two two", "en", "c"),
    (None, "en", "d"), ("", "en", "d"), ("eins", "de", "a"), ("zwei", "de", "b"), ("only one source", "fr", "a"), ("one one", None, "a"), ("one", None, "b"), ("one", None, "b"),
    ("x " * 50_000 + "one", "en", "e"), ("12 ! \x7f \x00", "es", None), ("12", "es", "ñ"), ("12", "es", "z"),
]
RANDOM = [(" ".join(WORDS[(i * j * j) % 600] for j in range(40)), "xx", f"s{i % 7}") for i in range(200)]


@pytest.fixture(scope="module")
def audited(spark):
    rows = AUDITED + [r for r in AUDITED for _ in range(2)] + RANDOM
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return rows, df.selectExpr("*", "1 AS doc_id", "'?' AS term", "'?' AS n", "'?' AS block", "'?' AS kept", "'?' AS tile")


@pytest.mark.parametrize("sizes", [{}, {"CELLS": 256}, {"CELLS": 256, "TILE": 2, "TOP_TERMS": 200, "WALK": 64}])
def test_audit(audited, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rows, df = audited
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == plain_audit(rows)


def test_audit_of_nothing(audited):
    assert divergence.audit(audited[1].limit(0)).count() == 0


def test_share_is_exact_for_large_counts():
    got = divergence.share(np.array([0, 10**12 + 7]), 10**13 + 1, 12345)
    assert got.tolist() == [1 + 10**9 // (10**13 + 12346), 1 + 10**9 * (10**12 + 8) // (10**13 + 12346)]


def test_trees_share_equal_parts():
    counts = np.zeros((3, 64), np.int64)
    counts[0, 5] = counts[1, 5] = 2
    counts[2] = np.arange(64)
    forest = divergence.Forest(counts)
    assert forest.roots[0] == forest.roots[1] and len(forest.children[0][0]) < 3 * 32
    at, a, b, total = forest.walk(np.array([0, 0]), np.array([1, 2]))
    assert np.count_nonzero(at == 0) == 2  # equal trees: a leaf of count 0 and one of count 2, each priced once
    prices = forest.values[a] * 1000 + forest.values[b]
    assert total(prices).tolist() == [2002, 2000 + sum(range(64))]


# ------------------------------------------------------------------------ language ID


def plain_phrases(text, sample):
    """Phrases of a text, parsed from the left, in pieces."""
    n = 0
    for k in range(0, len(text), langid.PIECE):
        piece = text[k : k + langid.PIECE]
        i = 0
        while i < len(piece):
            length = 1
            while i + length < len(piece) and piece[i : i + length + 1] in sample:
                length += 1
            i, n = i + (length if piece[i : i + 1] in sample else 1), n + 1
    return n


def test_phrases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    samples = langid.samples(docs, 3000)
    model = langid.Model(samples)
    texts = [r.text for r in docs.limit(40).collect()] + ["", "日本 Ünï öß", "a" * 5000, "\0\0x"]
    data = [langid.normal(t) for t in texts]
    want = [[plain_phrases(d, samples[n]) for n in model.names] for d in data]
    assert model.phrases(data).tolist() == want
    for text, d, phrases, name, score in zip(texts, data, want, *model.predict(texts)):
        costs = sorted((c * log2(len(samples[n]) + 1), n) for c, n in zip(phrases, model.names))
        if any(c.isalpha() for c in text):
            assert name == costs[0][1] and abs(score - (1 - costs[0][0] / costs[1][0])) < 1e-12
        else:
            assert (name, score) == ("und", 0)


def test_identify_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs, langid.Model(langid.samples(docs))).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_samples_leave_out_held_out_and_unlabelled(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{'held' if zlib.crc32(str(i).encode()) % 3 == 1 else ''}", "en") for i in range(200)]
    rows += [(None, "noid", "en"), (1000, "nolang", None), (1001, None, "en"), (1002, "123", "zz"), (3, "twice", "en")]
    got = langid.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {"en"} and not any(w in got["en"] for w in (b"held", b"noid", b"nolang"))


def test_identify_edges(spark):
    schema = "doc_id long, text string, lang string"
    model = langid.Model({"en": b"the cat sat on the mat ", "de": b"die katze sitzt auf der matte "})
    rows = [(None, "the cat", "x"), (1, None, "en"), (2, "", "en"), (3, "12 ½ \t\n", "en"), (4, "der Katze", None), (4, "der Katze", None), (5, "the mat " * 100_000, "de"), (6, "日本", "")]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS score", "1 AS held_out", "1 AS order")
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(df, model).collect()), key=repr)
    assert got[:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (5, "en")] and got[-1] == (None, "en")
    assert langid.identify(df.limit(0), model).count() == 0
    none = langid.Model(langid.samples(df.limit(0)))
    assert {(r.lang_pred, r.score) for r in langid.identify(df, none).collect()} == {("und", 0.0)}
    only = langid.Model({"en": b"the cat"}).predict(["cat", None])
    assert only == (["en", "und"], [1.0, 0.0])


def test_long_texts_are_parsed_whole():
    model = langid.Model({"en": b"the cat sat on the mat ", "de": b"die katze sitzt auf der matte "})
    assert model.predict(["the cat " * 300 + "katze sitzt auf der matte " * 3000])[0] == ["de"]


# ------------------------------------------------------------------------ prefix trie


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, convs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(convs) - 1) * len(n[-1][1]) if n else 0
    digest = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted((min(c), len(n), min(members[n[:-1]]) if n else -1, len(c), children[n], leaves[n], saved[n], digest(n)) for n, c in members.items())


def same_trie(df, rows, every=100):
    got = prefixtrie.trie(df, every)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted(tuple(-1 if x is None else x for x in r) for r in got.collect())
    assert got == plain_trie(rows)


def test_trie(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    same_trie(df, [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


@pytest.mark.parametrize("held", [prefixtrie.HELD, 3])
def test_trie_edges(spark, monkeypatch, held):
    monkeypatch.setattr(prefixtrie, "HELD", held)
    monkeypatch.setattr(prefixtrie, "ID_BITS", 6)
    rows = [(None, 1, "user", "no id"), (7, None, "user", "null turn first"), (7, 0, "user", "b"), (8, 5, None, None), (8, 6, "", ""), (8, 7, "ü", "🙂日本")]
    rows += [(100, i, "user", f"base {i}") for i in range(7)] + [(i, 0, "user", "hi") for i in range(101, 199)]
    rows += [(i, j, "user", "same") for i in range(300, 700) for j in range(1 + i % 9)]
    rows += [(i, j, "bot", f"deep {j}") for i in (900, 901, 902) for j in range(150 - (i - 900))] + [(1200, 0, "u", "x" * 100_000), (1201, 0, "u", "twice"), (1201, 0, "u", "twice")]
    rows += [(2**62 + i, 0, "u", "far") for i in (0, 1, 2, 100)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS path", "1 AS h", "1 AS node", "1 AS chars")
    same_trie(df, rows)
    assert prefixtrie.trie(df.limit(0)).count() == 0


paths = st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), max_size=30)


@settings(max_examples=300, deadline=None)
@given(paths)
def test_zfast_trie(words):
    def chained(word):
        out = [b""]
        for w in word:
            out.append(out[-1] + w)
        return out[1:]

    trie = prefixtrie.ZFastTrie()
    for i, word in enumerate(words):
        known = {tuple(w[:d]) for w in words[:i] for d in range(len(w) + 1)} | {()}
        path = chained(word)
        node, common = trie.locate(path)
        assert common == max(d for d in range(len(word) + 1) if tuple(word[:d]) in known)
        assert node.parent is None or node.parent.depth < max(common, 1) <= node.depth
        trie.insert([(path, [1] * len(word), 1, i, i)])
        assert all(trie.handles[n.handle] is n for n in trie._summed() if n.parent)
    got = {r[0]: r[2:] for r in trie.expand()}
    members = defaultdict(list)
    for i, word in enumerate(words):
        for d in range(len(word) + 1):
            members[b"".join(word[:d])].append(i)
    assert got == {n: (len(n), 1 if n else 0, len(m), min(m), min(m), max(m)) for n, m in members.items()}


def test_two_fattest():
    for low, high in ((a, b) for b in range(1, 70) for a in range(b)):
        assert prefixtrie.two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)
    assert all(a < b for a, b in pairwise([0, prefixtrie.two_fattest(0, 9)]))
