"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (of UTF-8 bytes) and of itself, hashed into buckets; a
window of words is the mean of its words; a linear softmax over that mean gives the probability.
Vectors and softmax are trained jointly.  A document scores as its most toxic window, so a few
words in a long text are not averaged away; training alternates between choosing the windows that
stand for each document and fitting them.  Misspellings share n-grams with the words they come
from, and the training windows are also shown with misspelt words.

The model is linear once trained: a word contributes one number, which workers remember.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.llm.common import return_memory, returning, table, text_or_empty

#: labelled documents used for training: at most so many of each label, chosen by a hash of their id
TRAIN_DOCS = 2000
BUCKETS = 1 << 18
DIMENSION = 4
NGRAMS = (3, 4, 5, 6)
#: words of a window
WINDOW = 12
ROUNDS, EPOCHS, BATCH, RATE = 3, 5, 256, 0.05
#: factor of a mean before the softmax: one word in a window must be able to decide
SCALE = 60.0
THRESHOLD = 0.3
#: words a worker remembers before it starts anew
REMEMBERED = 400_000


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): the buckets of every word, those of word i being buckets[ends[i]:ends[i+1]].

    A word with both ends marked gives the n-grams of its UTF-8 bytes and itself.
    """
    raw = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(raw))
    power = np.multiply.accumulate(np.full(int(sizes.max(initial=1)), np.uint64(0x9E3779B97F4A7C15)))
    whole = np.add.reduceat(raw * power[np.arange(len(raw)) - np.repeat(starts, sizes)], starts) if len(words) else raw
    hashes, owners = [whole], [np.arange(len(words))]
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        rolled = np.full(len(at), np.uint64(n))
        for k in range(n):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + raw[at + k]
        hashes.append(rolled)
        owners.append(owner[at])
    mixed = np.concatenate(hashes)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    buckets = ((mixed >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int32)
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(words)))))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; a word that follows itself counts once."""
    words = (text or "").lower().encode().split()
    return [w for w, before in zip(words, [None, *words]) if w != before]


def held_out():
    """Rows that never take part in training."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


class Bags:
    """Numbers of words, and the buckets of every word in one flat array."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, words: list[bytes]) -> np.ndarray:
        for w in words:
            if w not in self.numbers:
                self.numbers[w] = len(self.words)
                self.words.append(w)
        return np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        done = len(self.ends) - 1
        if done < len(self.words):
            # some words at a time, so that intermediate arrays stay small
            parts = [subwords(self.words[i : i + 20_000]) for i in range(done, len(self.words), 20_000)]
            sizes = np.concatenate([np.diff(ends) for _, ends in parts])
            self.flat = np.concatenate([self.flat, *[flat for flat, _ in parts]])
            self.ends = np.concatenate((self.ends, np.cumsum(sizes) + self.ends[-1]))
        return self.flat, self.ends


def _misspelt(word: bytes, rng: random.Random) -> bytes:
    """The word with one letter left out, doubled, swapped with the next or replaced by a look-alike."""
    text = word.decode("utf-8", "replace")
    if len(text) < 4:
        return word
    i = rng.randrange(1, len(text) - 1)
    kind = rng.randrange(4)
    if kind == 0:
        text = text[:i] + text[i + 1 :]
    elif kind == 1:
        text = text[:i] + text[i] + text[i:]
    elif kind == 2:
        text = text[:i] + text[i + 1] + text[i] + text[i + 2 :]
    else:
        text = "".join({"i": "1", "o": "0", "e": "3", "a": "@", "s": "$", "t": "7"}.get(c, c) if rng.random() < 0.6 else c for c in text)
    return text.encode()


def _windows(scores: np.ndarray) -> np.ndarray:
    """Mean score of every window; a shorter text is one window."""
    width = min(WINDOW, len(scores))
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    return (sums[width:] - sums[:-width]) / width if width else np.zeros(1)


def _unfolded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of starts[1], and so on."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _fit(flat, ends, windows: list[np.ndarray], target: np.ndarray, model: dict[str, np.ndarray], rng) -> None:
    """Softmax regression on mean vectors; vectors, weights and bias move together."""
    widths = np.diff(ends)
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            sizes = np.array([len(windows[i]) for i in batch])
            words = np.concatenate([windows[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), sizes)
            buckets = flat[_unfolded(ends[words], widths[words])]
            owners = np.repeat(owner, widths[words])
            share = np.repeat(1 / (widths[words] * sizes[owner]), widths[words])
            used, slot = np.unique(buckets, return_inverse=True)
            begin = np.concatenate(([0], np.cumsum(np.bincount(owners))[:-1]))
            means = np.add.reduceat(model["vectors"][used][slot] * share[:, None], begin, axis=0)
            means *= SCALE
            logits = means @ model["weights"].T + model["bias"]
            logits -= logits.max(axis=1, keepdims=True)
            error = np.exp(logits)
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), target[batch]] -= 1
            pull = (error @ model["weights"])[owners] * (SCALE * share)[:, None]
            moved = np.stack([np.bincount(slot, pull[:, d], len(used)) for d in range(pull.shape[1])], axis=1)
            # plain steps: what is met once moves little, what many windows agree on adds up
            model["vectors"][used] -= RATE * moved / np.sqrt(np.bincount(slot))[:, None]
            model["weights"] -= RATE * np.clip(error.T @ means / len(batch), -1, 1)
            model["bias"] -= RATE * error.sum(axis=0) / len(batch)


def train(texts: Iterable[str], labels: list[int], seed: int = 5) -> tuple[np.ndarray, float]:
    """(bucket scores, bias): a window's logit is the bias plus the mean of its words' mean bucket scores."""
    rng, letters = np.random.default_rng(seed), random.Random(seed)
    bags = Bags()
    docs = [bags.add(tokens(t)) for t in texts]
    flat, ends = bags.arrays()
    # the first windows are chosen by the n-gram of each word that is most typical of label 1
    found = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for words, label in zip(docs, labels):
        once = np.unique(words)
        found[label][np.unique(flat[_unfolded(ends[once], np.diff(ends)[once])])] += 1
    shares = [(x + 1) / (labels.count(label) + 2) for label, x in enumerate(found)]
    typical = np.log(shares[1] / shares[0]) * (found[1] > 2)
    scores = np.maximum.reduceat(typical[flat], ends[:-1]) if len(flat) else np.zeros(0)
    model = {
        "vectors": (rng.random((BUCKETS, DIMENSION)) - 0.5) / 100,
        "weights": np.array([[-0.5], [0.5]]) * np.ones((2, DIMENSION)) / DIMENSION**0.5,
        "bias": np.zeros(2),
    }
    # few examples of label 1 are shown in more spellings
    spellings = max(2, min(10, 3000 // max(1, labels.count(1))))
    for _ in range(ROUNDS):
        windows, target = [], []
        for words, label in zip(docs, labels):
            if not len(words):
                continue
            means = _windows(scores[words])
            starts = [int(np.argmax(means))] if label else {int(np.argmax(means)), *rng.integers(0, len(means), 6).tolist()}
            for start in starts:
                window = words[start : start + WINDOW]
                shown = [window]
                if label:
                    shown += [bags.add([_misspelt(bags.words[w], letters) for w in window]) for _ in range(spellings)]
                windows += shown
                target += [label] * len(shown)
        flat, ends = bags.arrays()
        _fit(flat, ends, windows, np.array(target), model, rng)
        of_bucket = SCALE * model["vectors"] @ (model["weights"][1] - model["weights"][0])
        scores = np.add.reduceat(of_bucket[flat], ends[:-1]) / np.diff(ends) if len(flat) else scores
    return of_bucket.astype(np.float32), float(model["bias"][1] - model["bias"][0])


class Scorer:
    """Scores texts with a trained model; remembers the words it has met."""

    def __init__(self, of_bucket: np.ndarray, bias: float) -> None:
        self.of_bucket, self.bias, self.known = of_bucket, bias, {}

    def score(self, texts: list[str | None]) -> list[float]:
        split = [tokens(t) for t in texts]
        every = set().union(*split)
        if len(self.known) + len(every) > REMEMBERED:
            self.known.clear()
        new = list(every - self.known.keys())
        if new:
            buckets, ends = subwords(new)
            means = np.add.reduceat(self.of_bucket[buckets].astype(np.float64), ends[:-1]) / np.diff(ends)
            self.known.update(zip(new, means.tolist()))
        known = self.known
        best = [_windows(np.fromiter(map(known.__getitem__, words), np.float64, len(words))).max() for words in split]
        scores = 1 / (1 + np.exp(-np.clip(self.bias + np.array(best), -30, 30)))
        return np.where([len(words) > 0 for words in split], scores, 0.0).tolist()

    def score_all(self, column: pa.Array) -> list[float]:
        """Scores of a column of texts, about a megabyte at a time."""
        out, group, size = [], [], 0
        for value in column:
            group.append(value.as_py())
            size += len(group[-1] or "")
            if size >= 1 << 20:
                out += self.score(group)
                group, size = [], 0
        return out + (self.score(group) if group else [])


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled documents per label, none of them held out.

    Ids are picked from the labels, in hash order; texts are only read for them, without a shuffle.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [marked.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(limit) for label in (0, 1)]
    few = F.broadcast(picked[0].unionAll(picked[1]))  # at most 2 * limit ids
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(few, "doc_id").dropDuplicates(["doc_id"])
    return rows.orderBy(order, "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> tuple[np.ndarray, float] | None:
    """A model from the labelled documents, or None where a label has no example."""
    rows = training_rows(docs, labels, limit).toArrow()
    marks = rows["toxic"].to_pylist()
    if len(set(marks)) < 2:
        return None
    model = train((text.as_py() for text in rows["text"]), marks)
    del rows
    return_memory()  # the driver holds it for all later stages otherwise
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``, from whole texts alone.

    A text without words (null, empty, white space) scores 0.  Without a model every score is 0.
    Repeated rows repeat; a null doc_id is not held out.  Other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value) if shared.value else None
        for batch in batches:
            found = scorer.score_all(batch.column(2)) if scorer else [0.0] * batch.num_rows
            flags = [int(x >= threshold) for x in found]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array(flags, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(returning(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, float] | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value) if shared.value else None
        for batch in batches:
            clean = [x < threshold for x in scorer.score_all(batch.column(at))] if scorer else [True] * batch.num_rows
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(returning(run), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(docs, labels))
