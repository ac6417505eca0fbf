"""Language-model scoring by context-tree weighting over bytes.

The next byte is eight binary decisions, each at a node of a binary tree of bytes (the bits before
it).  For every node there is a context tree over the last DEPTH bytes; each of its contexts holds
the counts of both bits in the training texts and their Krichevsky-Trofimov estimate.  Weighting
mixes the estimates of all depths: a context stops with the posterior weight of its own estimate
against the product of its children, and passes the rest on to the deeper context.

Counts are gathered over all training texts, aggregated before the shuffle, and rolled up depth by
depth; weights are then passed down again.  A bit is scored by the deepest of its contexts that training
met: where the deeper one was never met, the rest of the weight goes to that deepest one's estimate.

The whole tree stays in the shared folder.  The most frequent of the longest contexts, MAX_NODES at most, become
a cache for the scoring tasks: bytes all of whose bits have their longest context in it are looked up there, as one
number per byte with its context.  All other bytes are joined, once per distinct byte with its context, to the levels
of the tree; a tree of at most MAX_NODES contexts is sent whole instead.

Texts are lower-cased (A-Z) and end with an end symbol, a byte that UTF-8 never has; before the
text stand end symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.llm.common import delete_path, return_memory, staged, table, text_or_empty, work_path
from jobmarket.llm.substrings import Words

DEPTH = 5
MAX_NODES = 4_000_000
END = b"\xff"
#: bytes of texts that are counted or scored together
GROUP_BYTES = 2 << 20
#: a word with at least this share of the training tokens is looked up in the task (so at most 50,000 words)
FREQUENT = 50_000


def held_out() -> Column:
    """Rows that the model doesn't learn from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def _groups(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, lower-cased texts) of the last column, about ``limit`` bytes at a time."""
    texts, size, first = [], 0, 0
    for i, value in enumerate(batch.column(batch.num_columns - 1)):
        texts.append((value.as_py() or "").encode().lower())
        size += len(texts[-1])
        if size >= limit:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(gram, text): for each byte and end of each text the ``depth`` bytes before it and itself, as one number."""
    raw = np.frombuffer(END * depth + END.join(t + END * (depth - 1) for t in texts) + END, np.uint8)
    out = np.zeros(len(raw) - depth, np.int64)
    for j in range(depth + 1):
        out = (out << 8) | raw[j : j + len(out)]
    sizes = np.array([len(t) + 1 for t in texts])
    # of every text, len + 1 positions count; the depth - 1 after them only refill the context
    starts = np.cumsum(sizes + depth - 1) - (sizes + depth - 1)
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    return out[at], np.repeat(np.arange(len(texts)), sizes)


def _summed(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in kept])).astype(np.int64)


def _counted(of_texts, key: str):
    """Kernel: how often each key of ``of_texts(texts)`` occurs in a partition, merged as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for _, texts in _groups(batch, GROUP_BYTES):
                kept.append(np.unique(of_texts(texts), return_counts=True))
                size += len(kept[-1][0])
                if size > 2_000_000:
                    kept = [_summed(kept)]
                    size = len(kept[0][0])
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept.pop()], [key, "n"])
                        size = 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(kept)], [key, "n"])

    return run


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series eight steps further up."""
    up = x + 8
    steps = sum((F.ln(x + i) for i in range(1, 8)), F.ln(x))
    series = 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up)
    return (up - 0.5) * F.ln(up) - up + 0.5 * log(2 * pi) + series - steps


def _estimate(zeros: str = "n0", ones: str = "n1") -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    a, b = F.col(zeros), F.col(ones)
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - log(pi)


def _parent(depth: int) -> Column:
    """Context without its oldest byte."""
    return F.col("ctx").bitwiseAND(F.lit((1 << 8 * (depth - 1)) - 1))


def context_tree(docs: DataFrame, depth: int = DEPTH) -> tuple[list[DataFrame], list[str]]:
    """Per depth (ctx, node, p, n): the mixed probability of bit 1 at each context and node; and the paths they read.

    ``docs`` has the training texts.
    """
    spark, paths = docs.sparkSession, []

    def keep(df: DataFrame) -> DataFrame:
        paths.append(work_path(spark))
        return staged(df, paths[-1])

    counts = docs.select("text").mapInArrow(_counted(lambda texts: grams(texts, depth)[0], "gram"), "gram long, n long")
    counts = counts.groupBy("gram").agg(F.sum("n").alias("n"))
    bits = [
        F.struct(
            F.shiftright(F.col("x"), 8 - i).bitwiseOR(F.lit(1 << i)).alias("node"),
            F.shiftright(F.col("x"), 7 - i).bitwiseAND(F.lit(1)).alias("bit"),
        )
        for i in range(8)
    ]
    level = (
        counts.select(F.shiftright("gram", 8).alias("ctx"), F.col("gram").bitwiseAND(F.lit(255)).alias("x"), "n")
        .select("ctx", "n", F.explode(F.array(*bits)).alias("d"))
        .groupBy("ctx", "d.node")
        .agg(F.sum(F.expr("n * (1 - d.bit)")).alias("n0"), F.sum(F.expr("n * d.bit")).alias("n1"))
        .withColumn("own", _estimate())
        .withColumn("weighted", F.col("own"))
    )
    levels = {depth: keep(level)}
    for d in range(depth, 0, -1):
        up = levels[d].groupBy(_parent(d).alias("ctx"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below")
        )
        up = up.withColumn("own", _estimate())
        # log(half of one + half of the other)
        both = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - log(2)
        levels[d - 1] = keep(up.withColumn("weighted", both).drop("below"))
    served, above = [], None
    for d in range(depth + 1):
        here = levels[d].withColumn("kt", (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0))
        stop = F.exp(F.col("own") - F.col("weighted") - log(2)) if d < depth else F.lit(1.0)
        here = here.withColumn("stop", stop)
        if above is None:
            here = here.withColumn("passed", F.lit(1.0)).withColumn("mixed", F.lit(0.0))
        else:
            down = above.select(
                F.col("ctx").alias("up"), "node",
                (F.col("mixed") + F.col("passed") * F.col("stop") * F.col("kt")).alias("mixed"),
                (F.col("passed") * (1 - F.col("stop"))).alias("passed"),
            )
            here = here.withColumn("up", _parent(d)).join(down, ["up", "node"]).drop("up")
        above = keep(here.select("ctx", "node", "n0", "n1", "kt", "stop", "mixed", "passed"))
        served.append(above.select("ctx", "node", (F.col("mixed") + F.col("passed") * F.col("kt")).alias("p"), (F.col("n0") + F.col("n1")).alias("n")))
    return served, paths


def frequent_nodes(levels: list[DataFrame], most: int | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """(keys, probabilities) in key order of all contexts, or of the longest with the most occurrences; and whether these are all.

    At most ``most`` (MAX_NODES) of them are taken, from a power of two of occurrences on.  Keys pack depth, context and node.
    Probabilities stay doubles: as floats those of frequent contexts would round to 1, and the other bit would score -inf.
    """
    most = MAX_NODES if most is None else most
    parts = [
        level.select(F.shiftleft("ctx", 8).bitwiseOR(F.col("node")).bitwiseOR(F.lit(d << 56)).alias("key"), "p", "n") for d, level in enumerate(levels)
    ]
    tree, deepest = reduce(DataFrame.unionAll, parts), F.col("key") >= F.lit((len(levels) - 1) << 56)
    sizes = tree.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("all"), F.count_if(deepest).alias("longest")).collect()
    least, kept, whole = 64, 0, sum(row["all"] for row in sizes) <= most
    for row in sorted(sizes, key=lambda r: -r["size"]):
        if not whole and kept + row["longest"] > most:
            break
        least, kept = row["size"], kept + row["longest"]
    wanted = tree if whole else parts[-1].where(F.col("n") >= F.lit(1 << least if least < 63 else (1 << 62)))
    rows = wanted.select("key", "p").toArrow()
    keys, values = rows["key"].to_numpy(), rows["p"].to_numpy()
    del rows
    order = np.argsort(keys)
    return keys[order], values[order], whole


def gram_scores(wanted: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(gram, score): log10 probability of the last byte after the others, from the whole tree; ``wanted`` are distinct grams.

    Grams meet the longest contexts first; only those that training hasn't met go on to shorter ones.
    """
    byte = F.col("gram").bitwiseAND(F.lit(255))
    nodes = [F.shiftright(byte, 8 - i).bitwiseOR(F.lit(1 << i)) for i in range(8)]
    bits = [F.shiftright(byte, 7 - i).bitwiseAND(F.lit(1)) for i in range(8)]

    def met(rows: DataFrame, d: int) -> DataFrame:
        contexts = levels[d].groupBy("ctx").agg(F.map_from_entries(F.collect_list(F.struct("node", "p"))).alias("found"))  # at most 255 nodes
        ctx = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * d) - 1))
        ps = [F.coalesce(F.col("ps")[i], F.try_element_at("found", n)) for i, n in enumerate(nodes)]
        return rows.withColumn("ctx", ctx).join(contexts, "ctx", "left").select("gram", F.array(*ps).alias("ps"))

    depth = len(levels) - 1
    nothing = F.array(*[F.lit(None).cast("double")] * 8)
    longest = staged(met(wanted.select("gram", nothing.alias("ps")), depth))
    missing = F.exists("ps", lambda p: p.isNull())
    rest = longest.where(missing)
    for d in range(depth - 1, -1, -1):
        rest = met(rest, d)
    chances = [F.coalesce(F.col("ps")[i], F.lit(0.5)) for i in range(8)]
    total = sum((F.log10(F.when(b == 1, p).otherwise(1 - p)) for p, b in zip(chances, bits)), F.lit(0.0))
    return longest.where(~missing).unionAll(rest).select("gram", total.alias("score"))


class Model:
    """Scores of the grams in the cache of frequent contexts; ``whole`` tells that it is the whole tree."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, whole: bool = True, depth: int = DEPTH) -> None:
        self.whole, self.depth = whole, depth
        first = np.searchsorted(keys, depth << 56)
        self.grams, self.scores = self._deepest(keys[first:] - (depth << 56), values[first:])
        # shorter contexts only count where the longest are known to be missing
        self.keys, self.values = (keys, values) if whole else (keys[:0], values[:0])
        self.depths = np.searchsorted(self.keys, np.arange(depth + 2, dtype=np.int64) << 56)

    @staticmethod
    def _deepest(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(grams, scores), in order of grams: those all of whose bits have their longest context in the cache.

        A node is met as often as those below it, so the nodes above a kept one are kept as well.
        """
        leaves = np.flatnonzero(keys & 128)
        contexts, leaf, total = keys[leaves] & ~255, keys[leaves] & 255, np.zeros(len(leaves))
        for i in range(7):
            p = values[np.searchsorted(keys, contexts | (leaf >> (7 - i)))]
            total += np.log10(np.where((leaf >> (6 - i)) & 1, p, 1 - p))
        p = values[leaves]
        grams = (contexts | ((leaf & 127) << 1))[:, None] + np.arange(2)
        return grams.ravel(), (total[:, None] + np.log10(np.stack((1 - p, p), axis=1))).ravel()

    def code_lengths(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of the last byte of each gram after the others, and whether that needs no more of the tree.

        Grams are sorted, which keeps lookups near each other.
        """
        total, exact = np.zeros(len(grams)), np.zeros(len(grams), bool)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            exact = self.grams[at] == grams
            total = np.where(exact, self.scores[at], 0.0)
        if self.whole and not exact.all():
            total[~exact] = self._walked(grams[~exact])
            exact[:] = True
        return total, exact

    def _walked(self, grams: np.ndarray) -> np.ndarray:
        """log10 probabilities bit by bit, each by its longest context in the whole tree."""
        total, contexts, byte = np.zeros(len(grams)), grams >> 8, grams & 255
        for i in range(8):
            node, bit = (byte >> (8 - i)) | (1 << i), (byte >> (7 - i)) & 1
            p, open_ = np.full(len(grams), 0.5), np.arange(len(grams))
            for depth in range(self.depth, -1, -1):
                keys = self.keys[self.depths[depth] : self.depths[depth + 1]]
                if not len(open_) or not len(keys):
                    continue
                wanted = ((contexts[open_] & ((1 << 8 * depth) - 1)) << 8) | node[open_] | (depth << 56)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found = keys[at] == wanted
                p[open_[found]] = self.values[self.depths[depth] :][at[found]]
                open_ = open_[~found]
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """log10 probability of what the cache tells of each text and its end, and the rest: (text, gram, how often)."""
        found, text = grams(texts, self.depth)
        distinct, back = np.unique(found, return_inverse=True)
        scores, exact = self.code_lengths(distinct)
        total = np.bincount(text, np.where(exact, scores, 0.0)[back], len(texts))
        if exact.all():
            none = np.zeros(0, np.int64)
            return total, (none, none, none)
        left = np.flatnonzero(~exact[back])
        pairs, often = np.unique(text[left].astype(np.int64) * len(distinct) + back[left], return_counts=True)
        return total, (pairs // len(distinct), distinct[pairs % len(distinct)], often)


def _word_keys(texts: list[bytes]) -> np.ndarray:
    return Words(texts).hashes.view(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): training tokens by the hash of the word, without the ends."""
    counted = docs.select("text").mapInArrow(_counted(_word_keys, "word"), "word long, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _rare_words(words: np.ndarray):
    """Kernel over (doc_id, mark, text): how often each word outside ``words`` is in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for first, texts in _groups(batch, GROUP_BYTES // 2):
                found = Words(texts)
                keys = found.hashes.view(np.int64)
                slot = np.minimum(np.searchsorted(words, keys), max(len(words) - 1, 0))
                rare = words[slot] != keys if len(words) else np.ones(len(keys), bool)
                keys, text = keys[rare], found.document[rare]
                order = np.lexsort((keys, text))
                keys, text = keys[order], text[order]
                new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])))[: len(keys)]
                rows = pa.array(text[new] + first)
                counts = np.diff(np.append(new, len(keys)))
                yield pa.RecordBatch.from_arrays([ids.take(rows), marks.take(rows), pa.array(keys[new]), pa.array(counts)], ["doc_id", "mark", "word", "k"])

    return run


def _scored(shared, words: np.ndarray, logs: np.ndarray):
    """Kernel over (doc_id, mark, held_out, text): model score, tokens, what the frequent words add, and grams left to score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, texts in _groups(batch, GROUP_BYTES):
                score, (owner, gram, often) = model.score(texts)
                found = Words(texts)
                keys = found.hashes.view(np.int64)
                slot = np.minimum(np.searchsorted(words, keys), max(len(words) - 1, 0))
                known = words[slot] == keys if len(words) else np.zeros(len(keys), bool)
                text = found.document[known]
                columns = [batch.column(i).slice(first, len(texts)) for i in range(3)]
                columns.append(pa.array(np.diff(found.first) + 1))
                columns.append(pa.array(np.bincount(text, minlength=len(texts))))
                columns.append(pa.array(np.bincount(text, logs[slot[known]] if len(text) else None, len(texts)).astype(np.float64)))
                columns.append(pa.array(score))
                offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
                columns += [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (gram, often)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "held_out", "n_tokens", "frequent", "sum", "score", "grams", "often"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """Scores of every whole text by the model and by a base of single words, one row per row of ``docs``.

    Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; logarithms to base 10.
    Tokens are lower-cased words and one end.  Null texts count as empty, a null doc_id is not held out,
    repeated rows repeat and count as often in training.  Without training texts every bit has
    probability 1/2.  Other columns are ignored.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), held_out().alias("held_out"), text.alias("text"))
    training = rows.where(~F.col("held_out"))
    levels, paths = context_tree(training)
    shared = spark.sparkContext.broadcast(Model(*frequent_nodes(levels)))  # of at most MAX_NODES contexts
    return_memory()
    ends = training.count()
    counts = staged(word_counts(training))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total = whole["n"] + ends
    bottom = float(np.log10(total + 0.5 * (whole["v"] + (ends > 0) + 1)))
    frequent = counts.where(F.col("n") * FREQUENT >= total).toArrow() if total else counts.limit(0).toArrow()
    order = np.argsort(frequent["word"].to_numpy())
    words, often = frequent["word"].to_numpy()[order], frequent["n"].to_numpy()[order]
    rare = rows.select("doc_id", "mark", "text").mapInArrow(_rare_words(words), "doc_id long, mark long, word long, k long")
    light = counts.where(F.col("n") * FREQUENT < total)
    fields = "doc_id long, mark long, held_out boolean, n_tokens long, frequent long, sum double, score double, grams array<long>, often array<long>"
    scored = staged(rows.mapInArrow(_scored(shared, words, np.log10(often + 0.5)), fields))
    left = scored.select("doc_id", "mark", F.explode(F.arrays_zip("grams", "often")).alias("g")).select("doc_id", "mark", "g.*")
    asked = staged(gram_scores(left.select(F.col("grams").alias("gram")).distinct(), levels))
    for path in paths:
        delete_path(spark, path)
    # words and grams that the caches don't tell: both are sums per text
    of_words = rare.join(light, "word", "left").select(
        "doc_id", "mark", F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0).alias("known"),
        (F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("sum"), F.lit(0.0).alias("score"),
    )
    of_grams = left.join(asked, F.col("grams") == F.col("gram")).select(
        "doc_id", "mark", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("sum"), (F.col("score") * F.col("often")).alias("score")
    )
    looked_up = of_words.unionAll(of_grams).groupBy("doc_id", "mark").agg(
        F.sum("known").alias("rare_known"), F.sum("sum").alias("rare_sum"), F.sum("score").alias("rare_score")
    )
    # rows that repeat in full have each added to the sums of their words
    copies = scored.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"))
    per_text = copies.join(
        looked_up.withColumnsRenamed({"doc_id": "id", "mark": "m"}), (F.col("doc_id").eqNullSafe(F.col("id"))) & (F.col("mark") == F.col("m")), "left"
    ).select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "copies", "rare_known", "rare_sum", "rare_score")
    joined = scored.drop("grams", "often").join(per_text, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")))
    end = float(np.log10(ends + 0.5))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("frequent") + (F.coalesce("rare_known", F.lit(0)) / F.col("copies")).cast("long") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("rare_sum", F.lit(0.0)) / F.col("copies") + end - F.col("n_tokens") * bottom).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0)) / F.col("copies")).alias("score"),
    )


def op6_contexttree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
