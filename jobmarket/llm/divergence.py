"""Source divergence audit: how the term distributions of a language's sources differ.

Terms of a language are dealt to blocks by hash; inside a block they are numbered by falling count,
which makes their term ids.  Over the ids of a block every source has a segment tree of its counts,
and so has the language.  Trees are hash-consed: equal counts are one leaf, equal pairs of children
are one inner node, shared between all trees of the block.  Two trees are priced by walking both at
once from the roots; a pair of nodes that the walk has met before in these trees is priced once.

Only counts are shuffled, never texts.  A block holds a bounded number of (source, term) counts, and the
pairs of very many sources are dealt to tiles, so no task grows with the vocabulary or the sources.
All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmarket.llm.common import by_bounded, staged, table

#: a term is kept when so many documents of its language have it
LEAST_DOCS = 3
#: largest rank of the terms of a group
TOP_TERMS = 200
SCALE = 1_000_000_000
#: (source, term) cells of a block, at most about
CELLS = 1 << 18
BLOCK_TERMS = 8192
#: sources of a tile, about
TILE = 96
#: terms that a task counts before it hands the counts on
COUNTED = 200_000
#: leaves of the trees that one walk visits at most
WALK = 1 << 19

#: ASCII letters in lower case, bytes of other characters unchanged, all else a blank
_FOLD = bytes(b if b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, and characters beyond ASCII, of a text in UTF-8."""
    return text.translate(_FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs), summed as far as memory allows."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            words, counts = list(n), list(n.values())
            for i in range(0, len(words), 100_000):
                part = words[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(part)),
                        pa.array([source] * len(part)),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array(counts[i : i + 100_000], pa.int64()),
                        pa.array(map(docs.__getitem__, part), pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
        found.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(langs, sources, texts, strict=True):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), Counter(terms(text.as_py()))
            n.update(own)
            docs.update(own.keys())
            size += len(n) - before
            if size > COUNTED:
                yield from rows()
                size = 0
    yield from rows()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(lang, term, total, cells): kept terms with their counts (source, n) per source."""
    every = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = every.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # one shuffle serves both sums; a term has a few rows per source and task
    cells = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        cells.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
        .where(F.col("docs") >= LEAST_DOCS)
        .drop("docs")
    )


def share(count, whole: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (whole + kept)), exact for counts of any size."""
    count = np.asarray(count, np.int64)
    if len(count) and int(count.max()) >= 9_000_000_000:
        return np.array([1 + SCALE * (c + 1) // (whole + kept) for c in count.tolist()], np.int64)
    return 1 + SCALE * (count + 1) // (whole + kept)


class Forest:
    """Hash-consed segment trees over the same leaf positions, one per row of ``counts``."""

    def __init__(self, counts: np.ndarray) -> None:
        trees, used = counts.shape
        width = 1 << max(0, (used - 1).bit_length())
        leaves = np.full((trees, width), -1, np.int64)  # -1: no term at this position
        leaves[:, :used] = counts
        self.values, nodes = np.unique(leaves, return_inverse=True)
        nodes = nodes.reshape(leaves.shape)
        #: per level above the leaves, from below: left and right child of every node
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        size = len(self.values)
        while nodes.shape[1] > 1:
            keys, above = np.unique(nodes[:, 0::2] * size + nodes[:, 1::2], return_inverse=True)
            nodes = above.reshape(trees, -1)
            self.children.append((keys // size, keys % size))
            size = len(keys)
        self.roots, self.width = nodes[:, 0], width

    def walk(self, first: np.ndarray, second: np.ndarray):
        """Walk tree ``first[i]`` and tree ``second[i]`` together, for all i.

        Returns the distinct (i, leaf, leaf) met, and a function that turns their prices into one per i.
        """
        at, a, b = np.arange(len(first)), self.roots[first], self.roots[second]
        memo = []
        for left, right in reversed(self.children):
            below = [np.concatenate([x, y]) for x, y in ((at, at), (left[a], right[a]), (left[b], right[b]))]
            size = int(max(below[1].max(), below[2].max())) + 1 if len(at) else 1
            keys, inverse = np.unique((below[0] * size + below[1]) * size + below[2], return_inverse=True)
            memo.append(inverse)
            at, a, b = keys // (size * size), keys // size % size, keys % size

        def total(prices: np.ndarray) -> np.ndarray:
            for inverse in reversed(memo):
                each = prices[inverse]
                prices = each[: len(each) // 2] + each[len(each) // 2 :]
            return prices

        return at, a, b, total


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _shares(forest: Forest, tree: np.ndarray, leaf: np.ndarray, whole: np.ndarray, kept: int) -> np.ndarray:
    """Share of every (tree, leaf value); a position without a term has share 1 in all trees, so its price is 0."""
    out = np.ones(len(tree), np.int64)
    order = np.argsort(tree, kind="stable")
    ends = np.searchsorted(tree[order], np.arange(len(whole) + 1))
    for t in np.flatnonzero(np.diff(ends)):
        at = order[ends[t] : ends[t + 1]]
        count = forest.values[leaf[at]]
        out[at] = np.where(count < 0, 1, share(np.maximum(count, 0), int(whole[t]), kept))
    return out


def _table(lang: str, found: list[tuple[list, str, list, np.ndarray]]) -> pa.Table:
    """Rows of (sources, part, items, values) of a language."""
    return pa.table(
        {
            "lang": pa.array([lang] * sum(len(v) for *_, v in found), pa.string()),
            "source": pa.array([s for names, *_ in found for s in names], pa.string()),
            "part": pa.array([part for _, part, _, v in found for _ in range(len(v))], pa.string()),
            "item": pa.array([s for _, _, items, _ in found for s in items], pa.string()),
            "value": pa.array(np.concatenate([np.zeros(0, np.int64), *[v for *_, v in found]]), pa.int64()),
        }
    )


def _audit(key: tuple, groups: pa.Table, words: pa.Table) -> pa.Table:
    """Prices of one block and pair of tiles: (lang, source, part, item, value)."""
    lang, _, low, high = (k.as_py() for k in key)
    if not groups.num_rows:  # tiles without a source
        return _table(lang, [])
    groups = groups.sort_by("source")
    sources, tiles = groups["source"].to_pylist(), groups["tile"].to_numpy()
    kept = groups["kept"][0].as_py()
    words = words.sort_by([("total", "descending"), ("term", "ascending")])
    number = {s: i for i, s in enumerate(sources)}
    # the last tree is the language's
    counts = np.zeros((len(sources) + 1, words.num_rows), np.int64)
    cells = words["cells"].combine_chunks()
    column = np.repeat(np.arange(words.num_rows), np.diff(cells.offsets.to_numpy()))
    flat = cells.flatten()
    row = np.array([number[s] for s in flat.field("source").to_pylist()], np.int64)
    counts[row, column] = flat.field("n").to_numpy()
    counts[-1] = words["total"].to_numpy()
    whole = np.append(groups["whole"].to_numpy(), groups["lang_whole"][0].as_py()).astype(object)
    out: list[tuple[list, str, list, np.ndarray]] = []
    if words.num_rows:
        forest = Forest(counts)
    i, j = np.triu_indices(len(sources), 1)
    wanted = np.minimum(tiles[i], tiles[j]) == low
    wanted &= np.maximum(tiles[i], tiles[j]) == high
    i, j = i[wanted], j[wanted]
    step = max(1, WALK // (forest.width if words.num_rows else 1))
    for s in range(0, len(i), step):
        x, y = i[s : s + step], j[s : s + step]
        there = back = np.zeros(len(x), np.int64)
        if words.num_rows:
            at, a, b, total = forest.walk(x, y)
            p, q = _shares(forest, x[at], a, whole, kept), _shares(forest, y[at], b, whole, kept)
            there, back = total(_price(p, q)), total(_price(q, p))
        names_x, names_y = [sources[k] for k in x], [sources[k] for k in y]
        out += [(names_x, "pair", names_y, there), (names_y, "pair", names_x, back)]
    if low == high and words.num_rows:
        own = np.flatnonzero(tiles == low)
        step = max(1, WALK // forest.width)
        of = words["term"].to_pylist()
        for s in range(0, len(own), step):
            x = own[s : s + step]
            last = np.full(len(x), len(sources))
            at, a, b, _ = forest.walk(x, last)
            p, q = _shares(forest, x[at], a, whole, kept), _shares(forest, last[at], b, whole, kept)
            priced = np.where(p > q, _price(p, q), -1)
            size = len(forest.values)
            keys = (at * size + a) * size + b  # ascending
            for k, tree in enumerate(x):
                here = np.flatnonzero(counts[tree])
                leaf = np.searchsorted(forest.values, counts[[tree, -1]][:, here])
                value = priced[np.searchsorted(keys, (k * size + leaf[0]) * size + leaf[1])]
                here, value = here[value >= 0], value[value >= 0]
                if len(here) > TOP_TERMS:  # those below the 200th value of the block can't be among the first 200 of all
                    least = np.partition(value, len(value) - TOP_TERMS)[len(value) - TOP_TERMS]
                    here, value = here[value >= least], value[value >= least]
                out.append(([sources[tree]] * len(here), "term", [of[h] for h in here], value))
    return _table(lang, out)


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of ``docs``.

    Part ``pair``: item is another source of the language, value the divergence of the group from it.
    Part ``term``: item is a term more frequent in the group than in its language, value its share of
    the divergence; the first :data:`TOP_TERMS` ranks.  Ranks run by falling value, then by item.

    Null text, lang or source count as empty.  Every row is a document, repeated rows too.  A group without
    terms has zero counts; a language without kept terms has pairs of value 0.  A language of one
    source has no pairs.  Other columns are ignored; an empty table gives an empty result.
    """
    words = staged(vocabulary(docs))
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    whole = words.select("lang", F.explode("cells").alias("cell")).groupBy("lang", "cell.source").agg(F.sum("cell.n").alias("whole"))
    groups = staged(named.join(whole, ["lang", "source"], "left").withColumn("whole", F.coalesce("whole", F.lit(0).cast("long"))))
    sized = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("whole").alias("lang_whole"))
    sized = sized.join(words.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
    in_block = F.greatest(F.lit(64), F.least(F.lit(BLOCK_TERMS), F.floor(CELLS / F.col("sources"))))
    sized = sized.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / in_block)).cast("int"))
    sized = staged(sized.withColumn("tiles", F.ceil(F.col("sources") / TILE).cast("int")))

    unit = ["lang", "block", "low", "high"]
    tile = lambda source: F.pmod(F.xxhash64(source), F.col("tiles")).cast("int")
    tile_pairs = F.expr("explode(flatten(transform(sequence(0, tiles - 1), x -> transform(sequence(x, tiles - 1), y -> struct(x AS low, y AS high)))))")
    of_group = F.expr("explode(transform(sequence(0, tiles - 1), x -> struct(least(tile, x) AS low, greatest(tile, x) AS high)))")
    left = by_bounded(groups, sized, "lang").withColumn("tile", tile(F.col("source")))
    left = left.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("unit", of_group)
    left = left.select("lang", "block", "unit.*", "source", "tile", "whole", "lang_whole", "kept")
    right = by_bounded(words, sized.select("lang", "blocks", "tiles"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    right = right.withColumn("unit", tile_pairs).withColumn("cells", F.filter("cells", lambda c: tile(c["source"]).isin(F.col("unit.low"), F.col("unit.high"))))
    right = right.select("lang", "block", "unit.*", "term", "total", "cells")
    schema = "lang string, source string, part string, item string, value long"
    priced = left.groupBy(unit).cogroup(right.groupBy(unit)).applyInArrow(_audit, schema)
    # blocks add up; a term is in one block; stored, so that both parts share one pricing
    summed = staged(priced.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda part: summed.where(F.col("part") == part).withColumn("rank", F.row_number().over(order))
    return ranked("pair").unionAll(ranked("term").where(F.col("rank") <= TOP_TERMS))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS n_doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
    FROM documents
), found AS (
    SELECT n_doc, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs
), kept AS (
    SELECT lang, term, count(*) AS total FROM found GROUP BY lang, term HAVING count(DISTINCT n_doc) >= {LEAST_DOCS}
), cells AS (
    SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), grp AS (
    SELECT DISTINCT lang, source FROM docs
), sums AS (
    SELECT grp.lang, grp.source, coalesce(sum(n), 0)::HUGEINT AS whole FROM grp LEFT JOIN cells USING (lang, source) GROUP BY grp.lang, grp.source
), langs AS (
    SELECT lang, sum(total)::HUGEINT AS whole, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), shares AS (
    SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (s.whole + l.v) AS p
    FROM sums s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN cells c ON (c.lang, c.source, c.term) = (s.lang, s.source, k.term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), all_pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON (p.lang, p.source, p.item) = (a.lang, a.source, b.source)
), of_lang AS (
    SELECT lang, term, 1 + {SCALE}::HUGEINT * (total + 1) // (whole + v) AS q FROM kept JOIN langs USING (lang)
), terms AS (
    SELECT s.lang, s.source, s.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
    FROM shares s JOIN of_lang o ON s.lang = o.lang AND s.term = o.term WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value,
        row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM all_pairs
    UNION ALL
    SELECT lang, source, 'term', item, value,
        row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM terms
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
