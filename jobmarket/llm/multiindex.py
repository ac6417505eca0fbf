"""Approximate nearest neighbours by multi-index hashing.

Vectors become 64-bit codes: the signs after a rotation learned on a bounded sample (iterative
quantisation).  Codes are cut into four substrings and each substring is indexed.  By the
pigeonhole principle a code within r = 4t + j bits of the query has, in one of the substrings
0..j within t bits or in one of the others within t - 1, a near match; probing substrings in that
order retrieves every code within the radius.  What is retrieved is ranked by exact cosines.

The radius grows until a vector as near as the k-th best found so far would lie outside it only
with small probability (a code bit differs with probability angle / pi).

Queries and vectors meet in blocks of bounded size, each block pair a task of its own; only the
k best of each query and block go on.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmarket.llm.common import table

BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
#: vectors that the rotation is learned on, chosen by a hash of their id
TRAIN_VECTORS = 10_000
#: vectors and queries of one block
BLOCK, QUERIES = 16_384, 1024
#: standard deviations of the code distance that the radius leaves room for
MARGIN = 1.6


def learn_rotation(vectors: np.ndarray, rounds: int = 30, seed: int = 3) -> np.ndarray:
    """(dimension, BITS) projection whose signs lose least of the vectors."""
    rng = np.random.default_rng(seed)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    values, axes = np.linalg.eigh(unit.T @ unit)
    main = axes[:, np.argsort(-values)[:BITS]]
    if main.shape[1] < BITS:  # fewer dimensions than bits: further directions at random
        main = np.concatenate((main, main @ rng.normal(size=(main.shape[1], BITS - main.shape[1]))), axis=1)
    projected = unit @ main
    turn, _ = np.linalg.qr(rng.normal(size=(BITS, BITS)))
    for _ in range(rounds):
        signs = np.where(projected @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ projected)
        turn = (u @ v).T
    return main @ turn


def codes(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(vectors @ rotation >= 0, axis=1, bitorder="little").view("<u8")[:, 0]


def _substrings(code: np.ndarray) -> np.ndarray:
    return np.stack([(code >> np.uint64(WIDTH * j)) & np.uint64((1 << WIDTH) - 1) for j in range(PARTS)]).astype(np.int64)


MASKS = [np.array([sum(1 << b for b in bits) for bits in combinations(range(WIDTH), t)], np.int64) for t in range(WIDTH + 1)]


class MultiIndex:
    """Index of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray) -> None:
        self.ids, self.vectors, self.norms = ids, vectors, np.sqrt((vectors * vectors).sum(axis=1))
        self.rotation, self.codes = rotation, codes(vectors, rotation)
        parts = _substrings(self.codes)
        self.order = np.argsort(parts, axis=1, kind="stable")
        self.offsets = [np.searchsorted(p[o], np.arange((1 << WIDTH) + 1)) for p, o in zip(parts, self.order)]

    def _probe(self, part: int, value: int, distance: int) -> np.ndarray:
        """Rows whose substring differs from ``value`` in exactly ``distance`` bits."""
        buckets = MASKS[distance] ^ value
        begin, counts = self.offsets[part][buckets], self.offsets[part][buckets + 1] - self.offsets[part][buckets]
        begin, counts = begin[counts > 0], counts[counts > 0]
        return self.order[part][np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))]

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k best rows found other than row ``own``, ties to the smaller id."""
        code = codes(query[None, :], self.rotation)
        values = _substrings(code)[:, 0]
        norm = np.sqrt((query * query).sum())
        fresh = self.ids != own
        rows = distance = best = np.zeros(0, np.int64)
        scores = np.zeros(0)
        for radius in range(BITS + 1):
            t, part = divmod(radius, PARTS)
            if t <= WIDTH:
                found = self._probe(part, int(values[part]), t)
                found = found[fresh[found]]
                fresh[found] = False
                rows = np.append(rows, found)
                distance = np.append(distance, np.bitwise_count(self.codes[found] ^ code[0]).astype(np.int64))
            near, far = rows[distance <= radius], distance > radius
            rows, distance = rows[far], distance[far]
            if len(near):
                cosines = (self.vectors[near] * query).sum(axis=1) / (self.norms[near] * norm)
                best, scores = np.append(best, near), np.append(scores, cosines)
                order = np.lexsort((self.ids[best], -scores))[:k]
                best, scores = best[order], scores[order]
            if len(best) == k:
                p = np.arccos(np.clip(scores[-1], -1, 1)) / np.pi
                if radius >= BITS * p + MARGIN * np.sqrt(BITS * p * (1 - p)):
                    break
        return self.ids[best], scores


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles that can be compared: not null, not zero, all components finite, of the commonest length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(fine)
    commonest = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (commonest["n"] if commonest else 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def search(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for vectors whose id is divisible by ``every``, the k nearest others found.

    Score is the cosine in double precision.  Vectors null, zero, with a null or non-finite component,
    without id, or of another length than most take no part.  A repeated id is a candidate as often as
    it is there, but never for its own query; a repeated query id is searched once, by its smallest vector.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks, query_blocks = -(-n // BLOCK), -(-n // (QUERIES * every))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(TRAIN_VECTORS).select("v").toArrow()
    rotation = spark.sparkContext.broadcast(learn_rotation(_matrix(sample["v"])))

    def local(left, right):
        if not left.num_rows or not right.num_rows:
            kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
            return pa.table({n: pa.array([], t) for n, t in kinds.items()})
        index = MultiIndex(left["vec_id"].to_numpy(), _matrix(left["v"]), rotation.value)
        queries = zip(right["vec_id"].to_pylist(), _matrix(right["v"]))
        found = [(q, *index.search(q, v, k)) for q, v in queries]
        counts = [len(ids) for _, ids, _ in found]
        columns = (np.repeat([q for q, _, _ in found], counts), np.concatenate([x for _, x, _ in found]), np.concatenate([x for *_, x in found]))
        return pa.table({name: pa.array(c) for name, c in zip(("query_id", "vec_id", "score"), columns)})

    to_block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    to_queries = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks))
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    every_query = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))
    stored = rows.withColumn("block", to_block).withColumn("queries", every_query)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("queries", to_queries).withColumn("block", every_block)
    found = (
        stored.groupBy("block", "queries")
        .cogroup(asked.groupBy("block", "queries"))
        .applyInArrow(local, "query_id long, vec_id long, score double")
    )
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
