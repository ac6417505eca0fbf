"""Document fingerprints by Order MinHash.

A text's k-mers are numbered by occurrence, so that repeats count.  Hashes of (k-mer, occurrence)
fall into bins; the smallest ones of each bin are selected, put back into text order, and the
tuple of their k-mers is hashed.  Two texts agree in a bin only if the same k-mers are smallest
and stand in the same order, which makes the share of agreeing bins sensitive to edit distance.

The neighbour of a document in doc_id order comes with it in one range partitioning: cut points
are ids that occur, and the rows of a cut also go to the range above as its first neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.llm.common import MOST_TASKS, range_cuts, table, text_or_empty

K = 10
BINS = 64
PER_BIN = 2
#: bytes of text in one range of ids
RANGE_BYTES = 8 << 20

_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
#: code points hashed at a time, so that powers stay short
PIECE = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, np.uint64(base)))))


_UP = _powers(_BASE, PIECE + K)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), PIECE + K)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def kmers(points: np.ndarray) -> np.ndarray:
    """Hashes of all k-mers; a text of fewer code points is one k-mer, an empty one has none."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    k, out = min(K, n), []
    for i in range(0, n - k + 1, PIECE):
        part = points[i : i + PIECE + k - 1].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)], dtype=np.uint64)))
        out.append((sums[k:] - sums[:-k]) * _DOWN[: len(part) - k + 1])
    return _mixed(np.concatenate(out))


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How often the k-mer at each position has occurred before it."""
    ordered = np.sort(hashes)
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    counts = np.zeros(len(hashes), np.uint64)
    if len(repeated):
        slot = np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)
        at = np.flatnonzero(repeated[slot] == hashes)
        by = at[np.argsort(slot[at], kind="stable")]
        groups = slot[by]
        begin = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        counts[by] = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
    return counts


def signature(points: np.ndarray) -> np.ndarray:
    """One 16-bit number per bin; 0 for a bin without k-mers."""
    hashes = kmers(points)
    out = np.zeros(BINS, np.uint16)
    n = len(hashes)
    if not n:
        return out
    values = _mixed(hashes + occurrences(hashes) * _SPREAD)
    bins = (values >> np.uint64(58)).astype(np.int64)
    rest = values << np.uint64(6)
    # a first look at the smallest hashes only; all of them if some bin gets too few
    share = 8 * PER_BIN * BINS / n
    chosen = np.flatnonzero(rest < np.uint64(share * 2.0**64)) if share < 0.5 else np.arange(n)
    if len(chosen) < n and np.bincount(bins[chosen], minlength=BINS).min() < PER_BIN:
        chosen = np.arange(n)
    chosen = chosen[np.lexsort((rest[chosen], bins[chosen]))]
    bin_of = bins[chosen]
    place = np.arange(len(chosen)) - np.searchsorted(bin_of, bin_of)
    chosen, bin_of = chosen[place < PER_BIN], bin_of[place < PER_BIN]
    order = np.lexsort((chosen, bin_of))
    chosen, bin_of = chosen[order], bin_of[order]
    folded = np.zeros(BINS, np.uint64)
    place = np.arange(len(chosen)) - np.searchsorted(bin_of, bin_of)
    for i in range(PER_BIN):
        here = place == i
        folded[bin_of[here]] = _mixed(folded[bin_of[here]] * _SPREAD + hashes[chosen[here]] + np.uint64(i + 1))
    filled = np.bincount(bin_of, minlength=BINS) > 0
    out[filled] = (folded[filled] % np.uint64(65_535)).astype(np.uint16) + 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of agreeing bins among those that either text fills; 1 for two empty texts."""
    filled = (a | b) > 0
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _spelled(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
          ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over (code, doc_id, text) in ascending order: the row before is the next document in descending order."""
    before = None
    for batch in batches:
        rows = []
        for code, doc_id, text in zip(*(c for c in batch.columns)):
            text = text.as_py()
            if not code.as_py() & 1:
                before = (text, None)
                continue
            near, mark = before
            points = _points(text)
            own = signature(points)
            mark = signature(_points(near)) if mark is None else mark
            half = len(text) // 2
            edited = text[: len(text) - half] + near[:half]
            other = signature(_points(edited))
            rows.append((doc_id.as_py(), len(text), hashlib.sha256(edited.encode()).hexdigest(), _spelled(own), _spelled(other),
                         likeness(own, other), likeness(own, mark)))
            before = (text, own)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), FIELDS)], [n for n, _ in FIELDS])


def with_next(docs: DataFrame) -> DataFrame:
    """(code, doc_id, text) sorted so that in every range a row's neighbour comes right before it.

    An odd code marks a document, an even one a neighbour only.  Rows without doc_id come before
    all others, rows of one doc_id in the order of their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    whole = docs.agg(F.max(F.col("doc_id").cast("long")).alias("last"), F.sum(F.octet_length("text")).alias("bytes")).first()
    cuts = np.array(range_cuts(rows, "doc_id", 1 + (whole["bytes"] or 0) // RANGE_BYTES), np.int64)
    # a cut at the largest id would open an empty range
    cuts = cuts[cuts < whole["last"]] if len(cuts) else cuts
    last, least = whole["last"], np.iinfo(np.int64).min

    @F.pandas_udf("array<long>")
    def codes(doc_id: pd.Series) -> pd.Series:
        ids = doc_id.fillna(least).astype(np.int64).to_numpy()
        own = np.searchsorted(cuts, ids)
        also = np.searchsorted(cuts, ids, side="right")
        first = ids == (least if last is None else last)
        return pd.Series([[2 * o + 1] + ([2 * a] if a > o else []) + ([0] if f else []) for o, a, f in zip(own, also, first)])

    spread = rows.withColumn("code", F.explode(codes("doc_id"))).withColumn("range", F.expr("code div 2"))
    tasks = min(len(cuts) + 1, MOST_TASKS)
    return spread.repartitionById(tasks, F.col("range").cast("int")).sortWithinPartitions("code", "doc_id", "text").select("code", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, one row per row of ``docs``.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next
    document (in descending doc_id; after the last comes the first).  Null texts count as empty.
    Equal texts have equal fingerprints, texts shorter than a k-mer are one k-mer.  A single document
    is its own neighbour.  Other columns are ignored.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(_compared, schema)


def op4_orderhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
