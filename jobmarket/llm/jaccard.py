"""Near duplicates by SimHash fingerprints, and by the Jaccard similarity of word shingles.

1. A document is the set of the XXH64 of its lower-cased (A-Z) five-word shingles; equal sets are one node.
2. The SimHash fingerprints of the sets are linked as in :mod:`jobmarket.llm.simhash`: correlated bits grouped, thresholds by
   dynamic programming, keys probed and verified within RADIUS bits.  An exact check of the sets follows.  That connects copies
   with few changes.
3. At a similarity of 0.8 about 10, often 15 of 64 bits differ, and keys that allow for so many select almost nothing.  What
   fingerprints can't reach is found by MinHash: BANDS keys of ROWS minima each.  Two sets of similarity s share no key with
   probability (1 - s**ROWS)**BANDS: 7e-6 at 0.8, less above.
4. Nodes that share a key and are not connected yet are compared by their whole sets, in integers: first each with one leader
   of its key, for ROUNDS - 1 leaders.  A group of near copies is connected by then.
5. Of keys that are not connected yet, all pairs are held against each other by sketches of SKETCH bits, one of each
   of as many other minima: two sets of similarity s agree in a bit with probability (1 + s) / 2.  Only pairs that
   agree in AGREE bits are compared by their sets, and only at the first key they share; at 0.8 a pair fails that with
   probability 1e-5, at 0.65 it passes with 0.002.  So a large group whose members are alike, but not enough, makes few rows.
6. Links become components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmarket.llm import simhash
from jobmarket.llm.common import components, delete_path, returning, staged, work_path

WORDS = 5
BANDS, ROWS = 30, 5
#: bits in which linked fingerprints may differ
RADIUS = 2
#: rounds before all pairs that are not connected yet: one by fingerprints, then one for every leader of a key
ROUNDS = 3
#: bits of a sketch, and how many of them pairs must agree in (mean at 0.8 less 4.25 standard deviations)
SKETCH, AGREE = 1024, 881
#: slots of the filter that keeps sets without a partner from being shuffled
SLOTS = 1 << 22
#: shingles whose minima are taken at a time
BLOCK = 2048


def _factors(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


FACTORS, SKETCH_FACTORS = _factors(42, BANDS * ROWS), _factors(43, SKETCH)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; one shingle if there are fewer words, none without words."""
    tokens = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(tokens[i : i + words]), 42) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    return np.unique(np.array(hashes, np.uint64))


def node(found: np.ndarray) -> int:
    """Hash of a set of shingles; 0 of the empty one."""
    return xxhash.xxh64_intdigest(found.tobytes(), 42) if len(found) else 0


def _minima(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for i in range(0, len(found), BLOCK):
        least = np.minimum(least, (found[i : i + BLOCK, None] * factors).min(axis=0))
    return least


def band_keys(found: np.ndarray) -> list[int]:
    if not len(found):
        return []
    least = _minima(found, FACTORS)
    return [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]


def sketch(found: np.ndarray) -> np.ndarray:
    """One bit of a hash of each minimum, in words of 64."""
    least = _minima(found, SKETCH_FACTORS)
    bits = ((least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(values: list) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate([np.zeros(0, np.uint64), *[np.array(v, np.uint64) for v in values]])))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, keys, fps = [], [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            sizes.append(len(found))
            nodes.append(node(found))
            keys.append(band_keys(found))
            fps.append(simhash.majority(found))
        columns = [batch.column(0), _longs(nodes), pa.array(sizes, pa.int64()), _lists(keys), _longs(fps)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "size", "keys", "fp"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, found) to (node, sketch, keys)."""
    for batch in batches:
        found = [f.values.to_numpy().view(np.uint64) for f in batch.column(1)]
        columns = [batch.column(0), _lists([sketch(f) for f in found]), _lists([band_keys(f) for f in found])]
        yield pa.RecordBatch.from_arrays(columns, ["node", "sketch", "keys"])


def _sets(shared):
    """Kernel over (text): node and shingles of the texts whose slot is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                kept = [(h, f) for f in (shingles(t.as_py()) for t in batch.column(0).slice(start, 500)) if wanted[(h := node(f)) % SLOTS]]
                if kept:
                    yield pa.RecordBatch.from_arrays([_longs([h for h, _ in kept]), _lists([f for _, f in kept])], ["node", "found"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more."""
    left = sets.select(F.col("node").alias("a"), F.col("found").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("found").alias("y"))
    both = pairs.join(right, "b").join(left, "a")
    # i / (m + n - i) >= 4 / 5
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with shingles that connect all whose fingerprints differ in at most RADIUS bits."""
    filled = nodes.where("size > 0").select("node", "fp")
    firsts = staged(filled.groupBy("fp").agg(F.min("node").alias("first")))
    equal = filled.join(firsts, "fp").where("node <> first").selectExpr("first AS a", "node AS b")
    near = simhash.links(firsts.select("fp"), RADIUS)
    left, right = firsts.selectExpr("fp AS a", "first AS x"), firsts.selectExpr("fp AS b", "first AS y")
    return equal.unionAll(near.join(left, "a").join(right, "b").selectExpr("least(x, y) AS a", "greatest(x, y) AS b")).distinct()


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Staged links (a, b) that connect all nodes of similarity 0.8 or more; ``nodes`` (node, size, keys, fp) are distinct."""
    spark = docs.sparkSession
    near = staged(fingerprint_pairs(nodes))
    filed = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = staged(filed.join(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key"))
    met = shared.select("node").unionAll(near.select(F.explode(F.array("a", "b")).alias("node")))
    slots = met.select(F.pmod("node", F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow()  # at most SLOTS
    wanted = np.zeros(SLOTS, bool)
    wanted[slots["slot"].to_numpy()] = True
    sets = docs.select("text").mapInArrow(returning(_sets(spark.sparkContext.broadcast(wanted))), "node long, found array<long>")
    sets = staged(sets.groupBy("node").agg(F.first("found").alias("found")))
    close = 5 * F.least("x.size", "y.size") >= 4 * F.greatest("x.size", "y.size")
    pair = (F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    # links found so far: of a connected group only those to its root
    found, members, path = None, shared.withColumn("root", F.col("node")), None
    for turn in range(ROUNDS + 1):
        y = members
        if 0 < turn < ROUNDS:
            first = members.groupBy("key").agg(F.min_by(F.struct("node", "size", "root"), F.xxhash64("node", F.lit(turn))).alias("f"))
            x, apart = first.select("key", "f.*"), F.col("x.root") != F.col("y.root")
        elif turn == ROUNDS:
            open_sets = members.select("node").distinct().join(sets, "node").select("node", "found")
            sketches = staged(open_sets.mapInArrow(returning(_sketches), "node long, sketch array<long>, keys array<long>"))
            words = [F.col("sketch")[i].alias(f"w{i}") for i in range(SKETCH // 64)]
            y = x = members.select("key", "node", "size", "root").join(sketches.select("node", "keys", *words), "node")
            same = sum((F.bit_count(F.col(f"x.w{i}").bitwiseXOR(F.col(f"y.w{i}"))) for i in range(SKETCH // 64)), F.lit(0))
            earlier = [F.slice(f"{t}.keys", F.lit(1), (F.array_position(f"{t}.keys", F.col(f"{t}.key")) - 1).cast("int")) for t in "xy"]
            apart = (F.col("x.root") < F.col("y.root")) & (same <= SKETCH - AGREE) & ~F.arrays_overlap(*earlier)
        if turn:
            met = y.alias("y").join(x.alias("x"), (F.col("x.key") == F.col("y.key")) & apart & close)
        new = staged(_verified(met.select(*pair).distinct() if turn else near, sets))
        if turn == ROUNDS:
            found = found.unionAll(new)
        elif not turn or not new.isEmpty():
            roots = components(new if found is None else found.unionAll(new))
            found = roots.where("node <> root").selectExpr("root AS a", "node AS b")
            connected = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            # keys whose members are all connected are done
            open_ = connected.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
            previous, path = path, work_path(spark)
            members = staged(connected.join(open_, "key"), path)
            if previous:
                delete_path(spark, previous)
    delete_path(spark, path)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id), one row per row of ``docs``.

    Documents link when at least 0.8 of the shingles in either are in both; texts without words link with each other.
    component_id is the smallest doc_id reachable, the document's own included; null only where no member has an id.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, size long, keys array<long>, fp long"
    rows = staged(docs.select("doc_id", "text").mapInArrow(returning(_signatures), schema))
    classes = rows.groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = rows.select("node", "size", "keys", "fp").dropDuplicates(["node"])
    roots = components(links(docs, nodes))
    owned = staged(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "node").join(owned.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of every component.

    Repeated rows of a doc_id are one document and stay or go together; rows without doc_id stay.
    """
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
