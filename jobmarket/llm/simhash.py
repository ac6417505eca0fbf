"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A 64-bit fingerprint per document: every word shingle votes with the bits of its XXH64.
2. Bits are grouped so that correlated bits share a partition, and a dynamic program gives each
   partition a threshold of its own: with m partitions and thresholds summing to r - m + 1, two
   fingerprints within r bits agree up to the threshold in at least one partition.  Candidate
   counts are estimated from the agreement of every bit over all fingerprints; the number of
   partitions with the lowest estimated cost wins.
3. Each fingerprint files a key per partition and per set of bits it may miss there; fingerprints
   that share a key are compared in full.
4. A key shared by very many fingerprints is not compared pairwise.  Its members meet at points
   instead: two fingerprints within 2 bits share a point within 1 bit of both (64 bits + the
   fingerprint itself), and at most 65 fingerprints surround a point.  That is exact for r <= 2;
   larger radii add more points.
5. Links become components over distinct fingerprints, equal texts never being paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmarket.llm.common import components, staged, table

BITS = 64
#: fingerprints under one key that are compared pairwise; more of them meet at points
PAIRWISE = 128
#: shingles whose bits are unpacked at a time
BLOCK = 65_536


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without hashes."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of lower-cased (A-Z) word shingles, repeats counted; 0 without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        spans = [(0, len(joined))]
    else:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.concatenate(([0], spaces + 1))
        ends = np.concatenate((spaces, [len(joined)]))
        spans = zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64)
    return majority(hashes)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long.  Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64 matrix: how many fingerprints have both bits (its diagonal: one bit) set, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).astype("<i8").view(np.uint8)
            bits = np.unpackbits(raw.reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for row in rows:
        cells[row["cell"]] = row["n"]
    return cells


def plan(cells: np.ndarray, radius: int) -> list[tuple[tuple[int, ...], int]]:
    """[(bits, threshold)] of the cheapest partitioning; a threshold of -1 leaves a partition out."""
    n = max(cells[-1], 1.0)
    both = cells[:-1].reshape(BITS, BITS) / n
    one = np.diag(both).copy()
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    correlation = np.abs((both - np.outer(one, one)) / np.outer(spread, spread))
    agree = one**2 + (1 - one) ** 2
    best = None
    for m in range(2, radius + 2):
        groups = _grouped(correlation, m)
        costs = [_costs(agree[list(g)], n, radius) for g in groups]
        cost, thresholds = _allocate(costs, radius - m + 1, radius)
        if best is None or cost < best[0]:
            best = (cost, list(zip(groups, thresholds)))
    return best[1]


def _grouped(correlation: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m groups of about equal width; each takes the bits most correlated with those it has."""
    left, groups = set(range(BITS)), []
    for i in range(m):
        width = -(-len(left) // (m - i))
        rest = sorted(left)
        sub = correlation[np.ix_(rest, rest)] - np.eye(len(rest)) * 2
        group = [rest[int(np.argmax(sub.max(axis=1)))]]
        while len(group) < width:
            rest = sorted(left - set(group))
            group.append(rest[int(np.argmax(correlation[np.ix_(rest, group)].mean(axis=1)))])
        left -= set(group)
        groups.append(tuple(sorted(group)))
    return groups


def _costs(agree: np.ndarray, n: float, radius: int) -> list[float]:
    """Estimated keys plus candidate pairs for thresholds -1, 0, ... radius."""
    shares = np.zeros(radius + 1)
    shares[0] = 1.0
    for p in agree:
        shares[1:] = shares[1:] * p + shares[:-1] * (1 - p)
        shares[0] *= p
    within = np.cumsum(shares)
    return [0.0] + [4 * n * comb(len(agree), t) + n * n / 2 * within[t] for t in range(radius + 1)]


def _allocate(costs: list[list[float]], total: int, radius: int) -> tuple[float, list[int]]:
    """Thresholds in -1..radius of the given total at the lowest cost, partition by partition."""
    table = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for done, (spent, chosen) in table.items():
            for t in range(-1, radius + 1):
                item = (spent + cost[t + 1], [*chosen, t])
                if done + t not in new or item < new[done + t]:
                    new[done + t] = item
        table = new
    return table[total]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def filed(fps: DataFrame, parts: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """(fp, tag, key): the keys of every fingerprint; tag numbers the partition and the bits missed."""
    masks = []
    for bits, threshold in parts:
        whole = sum(1 << b for b in bits)
        if threshold >= 0:
            masks += [whole & ~sum(1 << b for b in missed) for missed in combinations(bits, threshold)]
    keys = [
        F.struct(F.lit(i).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
        for i, mask in enumerate(masks)
    ]
    return fps.withColumn("k", F.explode(F.array(*keys))).select("fp", "k.tag", "k.key")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``radius`` bits; column ``fp`` holds distinct values."""
    keys = staged(filed(fps, plan(bit_counts(fps), radius)))
    buckets = keys.groupBy("tag", "key").agg(F.count("*").alias("n")).where("n > 1")
    few = keys.join(buckets.where(f"n <= {PAIRWISE}").select("tag", "key"), ["tag", "key"])
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    same = (F.col("x.tag") == F.col("y.tag")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))
    compared = few.alias("x").join(few.alias("y"), same & close).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = keys.join(buckets.where(f"n > {PAIRWISE}").select("tag", "key"), ["tag", "key"]).select("fp").distinct()
    return compared.unionAll(_meetings(many, radius))


def _meetings(fps: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints that share a point, checked for the radius when it is odd."""
    reach = -(-radius // 2)
    flips = [_signed(sum(1 << b for b in bits)) for k in range(reach + 1) for bits in combinations(range(BITS), k)]
    points = fps.withColumn("point", F.explode(F.transform(F.lit(flips), lambda f: F.col("fp").bitwiseXOR(f))))
    if radius % 2 == 0:
        least = F.min("fp").over(Window.partitionBy("point"))
        return points.withColumn("least", least).where("fp <> least").selectExpr("least AS a", "fp AS b")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    pair = points.alias("x").join(points.alias("y"), (F.col("x.point") == F.col("y.point")) & (F.col("x.fp") < F.col("y.fp")) & close)
    return pair.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is the
    smallest doc_id reachable, the document's own included.  Null and empty texts have fingerprint
    zero and link like others.  A row without doc_id takes part; component_id is null only where no
    member has an id.  Repeated rows repeat in the result.  Other columns are ignored.
    """
    rows = staged(fingerprints(docs, words))
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    owned = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    named = owned.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """The document with the smallest doc_id of every component.

    Repeated rows of a doc_id are one document and stay or go together; rows without doc_id stay.
    """
    found = near_duplicates(docs, words, radius)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
