"""Prefix trie of conversations, built from z-fast tries.

A conversation is a path of turns; the prefix of its first d turns is known by a chained 128-bit digest.
Distinct paths are sorted and dealt to tasks in ranges.  Every task inserts its paths, a batch at a time,
into a z-fast trie: a compacted trie whose nodes are hashed under the digest of the prefix at their
two-fattest depth, so that the exit node of a path is found by fat binary search, in a number of
probes logarithmic in its length.  The compacted edges are then expanded to one row per prefix.

Prefixes that several ranges have in common are merged by digest.  Sums over subtrees come from the sorted
order: the subtree of a prefix is a run of paths, so they are differences of running sums.
Only digests and counts are shuffled after the turns were digested, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmarket.llm.common import prefix_sums, staged, table
from jobmarket.operators.skew import hot_keys, lookup_join

#: original turns of the conversation a multiple of this that others start with
BASE_EVERY = 100
ROOT = b""
#: digests that a trie holds before it is expanded and a new one started
HELD = 1_000_000
#: paths inserted together
BATCH = 4096
#: conversations whose ids agree but for so many low bits are joined to one piece of text before they meet in a digest
ID_BITS = 12


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & -1 << (low ^ high).bit_length() - 1


class Node:
    """Prefixes of ``path`` longer than those of ``parent``, down to ``depth``; ``chars`` goes with the path."""

    __slots__ = ("chars", "children", "convs", "depth", "ends", "first", "last", "least", "parent", "path")

    def __init__(self, parent: Node | None, depth: int, path: list[bytes], chars: list[int]) -> None:
        self.parent, self.depth, self.path, self.chars = parent, depth, path, chars
        self.children: dict[bytes, Node] = {}
        self.ends, self.convs, self.least, self.first, self.last = 0, 0, None, None, None

    @property
    def digest(self) -> bytes:
        return self.path[self.depth - 1]

    @property
    def handle(self) -> bytes:
        return self.path[two_fattest(self.parent.depth, self.depth) - 1]


class ZFastTrie:
    """Compacted trie of paths; a path is the list of the digests of its prefixes, shortest first."""

    def __init__(self) -> None:
        self.root = Node(None, 0, [], [])
        self.handles: dict[bytes, Node] = {}

    def locate(self, path: list[bytes]) -> tuple[Node, int]:
        """The exit node of ``path`` and the length of its longest prefix in the trie."""
        low, high, node = 0, len(path), self.root
        while low < high:
            f = two_fattest(low, high)
            found = self.handles.get(path[f - 1])
            if found is None:
                high = f - 1
            elif found.depth <= len(path) and found.digest == path[found.depth - 1]:
                node, low = found, found.depth
            else:  # the path leaves inside the edge of this node, at f or below
                return found, self._common(found, path, f)
        below = node.children.get(path[node.depth]) if node.depth < len(path) else None
        return (node, node.depth) if below is None else (below, self._common(below, path, node.depth + 1))

    @staticmethod
    def _common(node: Node, path: list[bytes], known: int) -> int:
        """Length of the longest common prefix of a node's path and ``path``, of which ``known`` are known to agree."""
        low, high = known, min(node.depth, len(path))
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if node.path[middle - 1] == path[middle - 1] else (low, middle - 1)
        return low

    def _add(self, parent: Node, depth: int, path: list[bytes], chars: list[int]) -> Node:
        node = Node(parent, depth, path, chars)
        parent.children[path[parent.depth]] = node
        self.handles[node.handle] = node
        return node

    def _split(self, node: Node, depth: int) -> Node:
        """Cut the edge of ``node`` at ``depth``; returns the new upper node."""
        del self.handles[node.handle]
        upper = self._add(node.parent, depth, node.path, node.chars)
        node.parent = upper
        upper.children[node.path[depth]] = node
        self.handles[node.handle] = node
        return upper

    def insert(self, rows: list[tuple[list[bytes], list[int], int, int, int]]) -> None:
        """Insert a batch of (path, characters of its turns, conversations, smallest conv_id, position in the order)."""
        for path, chars, convs, least, position in rows:
            node, common = self.locate(path)
            if common < node.depth:
                node = self._split(node, common)
            if common < len(path):
                node = self._add(node, len(path), path, chars)
            node.ends += convs
            node.least = least if node.least is None else min(node.least, least)
            node.first = position if node.first is None else min(node.first, position)
            node.last = position if node.last is None else max(node.last, position)

    def _summed(self) -> list[Node]:
        """All nodes, parents first, with the sums of their subtrees."""
        nodes = [self.root]
        for node in nodes:
            nodes += node.children.values()
        for node in nodes:
            node.convs = node.ends
        for node in reversed(nodes):
            up = node.parent
            if up is not None:
                up.convs += node.convs
                up.least = node.least if up.least is None else min(up.least, node.least)
                up.first = node.first if up.first is None else min(up.first, node.first)
                up.last = node.last if up.last is None else max(up.last, node.last)
        return nodes

    def expand(self) -> Iterator[tuple[bytes, bytes | None, int, int, int, int, int, int]]:
        """(digest, digest of the parent, depth, characters of the last turn, conversations, smallest conv_id, first and last position) of every prefix."""
        for node in self._summed():
            rest = (node.convs, node.least, node.first, node.last)
            if node.parent is None:
                if node.convs:
                    yield ROOT, None, 0, 0, *rest
                continue
            for depth in range(node.parent.depth + 1, node.depth + 1):
                yield node.path[depth - 1], node.path[depth - 2] if depth > 1 else ROOT, depth, node.chars[depth - 1], *rest


PREFIXES = "node binary, parent binary, depth int, chars int, convs long, least long, first long, last long"
_TYPES = pa.schema(
    [("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("chars", pa.int32())] + [(n, pa.int64()) for n in ("convs", "least", "first", "last")]
)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, chars, convs, least, position), sorted, to the prefixes of the range."""

    def rows(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        group = []
        for row in trie.expand():
            group.append(row)
            if len(group) == 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*group), _TYPES.types)], schema=_TYPES)
                group = []
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*group), _TYPES.types)], schema=_TYPES)

    trie, held = ZFastTrie(), 0
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = [c.to_pylist() for c in batch.slice(start, BATCH).columns]
            trie.insert(list(zip(*part)))
            held += sum(map(len, part[0]))
            if held > HELD:  # what two tries have in common is merged later, like what two tasks have
                yield from rows(trie)
                trie, held = ZFastTrie(), 0
    yield from rows(trie)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turn digests, characters) to (conv_id, path, characters)."""
    for batch in batches:
        paths = []
        for turns in batch.column(1).to_pylist():
            path, before = [], b""
            for turn in turns:
                before = hashlib.blake2b(before + turn, digest_size=16).digest()
                path.append(before)
            paths.append(path)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.list_(pa.binary())), batch.column(2)], ["conv_id", "path", "chars"])


def rebuilt(conversations: DataFrame, every: int = BASE_EVERY) -> DataFrame:
    """(conv_id, path, chars): the digests of the prefixes of every rebuilt conversation, and the characters of its turns.

    Conversation c starts with the first h turns of conversation ``c - c % every``, h being crc32(c) % 6, and
    goes on with its own turns after its first h.
    """
    role, text = [F.coalesce(c, F.lit("")) for c in ("role", "text")]
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn", digest.alias("digest"), F.char_length(text).alias("chars"))
    convs = conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = staged(convs.select("conv_id", F.expr("transform(turns, t -> struct(t.digest AS digest, t.chars AS chars))").alias("turns")))
    base = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    both = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    turns = F.expr("concat(if(h > 0, slice(coalesce(head, array()), 1, greatest(h, 1)), array()), slice(turns, h + 1, greatest(size(turns), 1)))")
    return both.select("conv_id", turns.alias("turns")).select("conv_id", "turns.digest", "turns.chars").mapInArrow(
        _chained, "conv_id long, path array<binary>, chars array<int>"
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, piece), sorted by node and order of the pieces, to (node, ends_sha256); one digest is open at a time."""
    node, digest = None, None
    for batch in batches:
        nodes, sums = [], []
        for n, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != node:
                if digest is not None:
                    nodes.append(node)
                    sums.append(digest.hexdigest())
                node, digest = n, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sums, pa.string())], ["node", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def _ends(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes that a conversation ends at.

    The ids of a node are hashed in one stream, as a digest must be; they arrive in pieces of up to 2**ID_BITS ids.
    """
    last = F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(ROOT))
    ids = paths.select(last.alias("node"), "conv_id", F.shiftright("conv_id", ID_BITS).alias("range"))
    pieces = ids.groupBy("node", "range").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("piece"))
    return pieces.repartition("node").sortWithinPartitions("node", "range").select("node", "piece").mapInArrow(_joined, "node binary, ends_sha256 string")


def trie(conversations: DataFrame, every: int = BASE_EVERY) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, from the empty one.

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.  Turns are ordered by turn, nulls first, then by digest of role and text; repeated rows are
    turns of their own.  Null role or text counts as empty.  Rows without conv_id are left out.  Other columns are
    ignored.  An empty table gives an empty result.  The digests of one conversation have to fit in a
    task; equal digests count as equal turns (128 bits).
    """
    spark = conversations.sparkSession
    paths = staged(rebuilt(conversations, every))
    distinct = paths.groupBy("path").agg(F.first("chars").alias("chars"), F.count("*").alias("convs"), F.min("conv_id").alias("least"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = staged(distinct).repartitionByRange(parts, "path").sortWithinPartitions("path")
    order = staged(order.withColumn("position", F.monotonically_increasing_id()))
    found = order.select("path", "chars", "convs", "least", "position").mapInArrow(_prefixes, PREFIXES)
    nodes = found.groupBy("node", "parent", "depth").agg(
        *[f(c).alias(c) for f, c in ((F.max, "chars"), (F.sum, "convs"), (F.min, "least"), (F.min, "first"), (F.max, "last"))]
    )
    nodes = staged(nodes)
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("children"))
    # a prefix weighs in at the first path that has it, and every path is the first one of its whole
    weighed = (
        nodes.join(children.withColumnRenamed("parent", "node"), "node", "left")
        .withColumn("children", F.coalesce("children", F.lit(0).cast("long")))
        .withColumn("weight", (F.col("convs") - 1) * F.col("chars"))
        .withColumn("leaf", (F.col("children") == 0).cast("long"))
    )
    deeper = Window.partitionBy("first").orderBy(F.desc("depth"))
    weighed = staged(weighed.withColumn("below", F.sum("weight").over(deeper)).withColumn("leaves_below", F.sum("leaf").over(deeper)))
    at = weighed.groupBy("first").agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaf"))
    at = at.withColumn("part", F.shiftright("first", 33))
    per_part = at.groupBy("part").agg(F.sum("weight").alias("part_weight"), F.sum("leaf").alias("part_leaf"))
    before = prefix_sums(prefix_sums(per_part, "part", "part_weight", "w0"), "part", "part_leaf", "l0")
    inside = Window.partitionBy("part").orderBy("first")
    running = at.join(F.broadcast(before), "part").select(  # one row per task of the sort
        F.col("first").alias("place"),
        (F.col("w0") + F.sum("weight").over(inside)).alias("weight_to"),
        (F.col("l0") + F.sum("leaf").over(inside)).alias("leaf_to"),
    )
    return _result(weighed, staged(running), nodes, _ends(paths))


def _result(weighed: DataFrame, running: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    upto = lambda name: running.select(F.col("place").alias(name), F.struct("weight_to", "leaf_to").alias(f"to_{name}"))
    sums = weighed.join(upto("first"), "first").join(upto("last"), "last").join(ends, "node", "left")
    above = nodes.select(F.hex("node").alias("parent_key"), F.col("least").alias("parent_conv_id"))
    # a node with very many children is looked up in a broadcast table
    counts = weighed.where("children > 0").select(F.hex("node").alias("parent_key"), F.col("children").alias("rows"))
    sums = lookup_join(sums.withColumn("parent_key", F.hex("parent")), above, "parent_key", hot_keys(counts, "parent_key"))
    return sums.select(
        F.col("least").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        F.col("convs").alias("n_convs"),
        F.col("children").alias("n_children"),
        (F.col("to_last.leaf_to") - F.col("to_first.leaf_to") + F.col("leaves_below")).alias("n_leaves"),
        (F.col("to_last.weight_to") - F.col("to_first.weight_to") + F.col("below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
