"""Substring dedup: passages that already start in a document with a smaller doc_id are removed.

1. Anchors.  Of the 6-word groups inside a window of 13 words, the one with the smallest hash is
   the window's anchor; equal windows have equal anchors and neighbouring windows mostly share one.
   Anchors met in two documents or more are kept; up to SENT_ANCHORS of them are broadcast, more
   are joined to the documents.
2. Segments.  The words of consecutive windows with the same kept anchor go to the shard of that
   anchor, equal segments once per batch.  Windows of an anchor that very many documents share
   are dealt out one by one by their own hash, so that no shard grows with it.
3. Every shard holds an FM-index of its segments: the Burrows-Wheeler transform of the word
   sequence in a wavelet matrix of packed bits.  Backward search, vectorised over windows, finds
   the suffix interval of each window (the matching statistic cut at 13 words); the smallest
   doc_id over the interval is the window's first document.
4. Windows whose first document is smaller than their own mark the words to remove.

Words are compared by a hash of their bytes, WORD_BYTES long: two windows that differ in one word are taken for
equal with probability 2**-48, in more words with far less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.llm.common import returning, staged, table, text_or_empty

WINDOW = 13
ANCHOR = 6
#: an anchor in more documents than this has its windows dealt out one by one
SHARED = 1000
#: bytes of text for which one more shard is made
SHARD_BYTES = 8 << 20
#: documents are scanned in groups of about this many bytes
GROUP_BYTES = 1 << 20

#: so many kept anchors are sent to the tasks (9 bytes each); more are joined to the documents
SENT_ANCHORS = 8_000_000
#: bytes of a word's hash that go to the shards
WORD_BYTES = 6

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Words:
    """Word hashes of a group of texts given as bytes; ``first`` has the position of each text's first word."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        powers = _powers(_BASE, len(raw))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)))
        inverse = _powers(_INVERSE, len(raw))
        values = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
        self.hashes = _mixed(values)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(starts, offsets)
        self.first[-1] = len(starts)
        self.document = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def windows(self) -> np.ndarray:
        """Positions at which a window starts that lies inside one text."""
        n = len(self.hashes) - WINDOW + 1
        return np.flatnonzero(self.document[:n] == self.document[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def anchors(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, position) of the anchor of each window: the smallest group hash, the leftmost if equal."""
        n = len(self.hashes) - ANCHOR + 1
        groups = np.zeros(n, np.uint64)
        for j in range(ANCHOR):
            groups = groups * _ROLL + self.hashes[j : j + n]
        groups = _mixed(groups)
        best, where = groups[at], at.copy()
        for j in range(1, WINDOW - ANCHOR + 1):
            other = groups[at + j]
            less = other < best
            best = np.where(less, other, best)
            where = np.where(less, at + j, where)
        return best, where


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first row, texts) in groups of about GROUP_BYTES; text is the last column."""
    texts, size, first = [], 0, 0
    for i, value in enumerate(batch.column(batch.num_columns - 1)):
        text = value.as_py().encode()
        texts.append(text)
        size += len(text)
        if size >= GROUP_BYTES:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def _mark(text: bytes) -> int:
    """Tells different texts of one doc_id apart."""
    value = xxhash.xxh32_intdigest(text)
    return value - (1 << 32) if value >> 31 else value


def _document_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for first, texts in _grouped(batch):
            words = Words(texts)
            at = words.windows()
            if not len(at):
                continue
            found, _ = words.anchors(at)
            document = words.document[at]
            order = np.lexsort((found, document))
            found, document = found[order], document[order]
            new = np.append(True, (found[1:] != found[:-1]) | (document[1:] != document[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(found[new].view(np.int64)), pa.array(ids[document[new] + first])], ["anchor", "doc_id"])


class Chosen:
    """The kept anchors as one sorted array, behind a bit table that most lookups end at."""

    def __init__(self, anchors: np.ndarray, hot: np.ndarray) -> None:
        self.anchors, self.hot = anchors, hot
        self.bits = max(16, min(27, len(anchors).bit_length() + 5))
        table = np.zeros(1 << self.bits, bool)
        table[self._place(anchors)] = True
        self.table = np.packbits(table, bitorder="little")

    def _place(self, anchors: np.ndarray) -> np.ndarray:
        return (anchors.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def masks(self, row: int, found: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kept, hot) for the anchors ``found`` of windows."""
        found = found.view(np.int64)
        place = self._place(found)
        kept = (self.table[place >> 3] >> (place & 7)) & 1 == 1
        single = np.zeros(len(found), bool)
        maybe = np.flatnonzero(kept)
        if len(maybe):
            slot = np.minimum(np.searchsorted(self.anchors, found[maybe]), len(self.anchors) - 1)
            kept[maybe] = self.anchors[slot] == found[maybe]
            single[maybe] = kept[maybe] & self.hot[slot]
        return kept, single


class ChosenByDocument:
    """The kept anchors of each row of a batch."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.lists = [(np.asarray(k.values), np.asarray(h.values)) for k, h in zip(batch.column("kept"), batch.column("hot"))]

    def masks(self, row: int, found: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept, single = np.zeros(len(found), bool), np.zeros(len(found), bool)
        edges = np.flatnonzero(np.diff(document, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            part = found[a:b].view(np.int64)
            for mask, anchors in zip((kept, single), self.lists[row + document[a]]):
                mask[a:b] = np.isin(part, anchors)
        return kept, single


def _segments(chosen, row: int, texts: list[bytes]):
    """Words of a group of texts, and arrays over its segments: text, first word, windows, shard key; None without any."""
    words = Words(texts)
    at = words.windows()
    if not len(at):
        return words, None
    found, where = words.anchors(at)
    document = words.document[at]
    keep, single = chosen.masks(row, found, document)
    at, found, where, document, single = at[keep], found[keep], where[keep], document[keep], single[keep]
    if not len(at):
        return words, None
    new = np.append(True, (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1) | single[1:])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    key = found[begin].copy()
    alone = single[begin]
    window = np.zeros(int(alone.sum()), np.uint64)
    for j in range(WINDOW):
        window = window * _ROLL + words.hashes[at[begin][alone] + j]
    key[alone] = _mixed(window)
    return words, (document[begin], at[begin], count, key)


def _segment_keys(words: Words, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit key of the words of each segment, from prefix sums."""
    powers = _powers(_ROLL, len(words.hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hashes * powers[:-1], dtype=np.uint64)))
    inverse = _powers(np.uint64(pow(int(_ROLL), -1, 1 << 64)), len(words.hashes))
    ends = starts + counts + WINDOW - 1
    return _mixed((sums[ends] - sums[starts]) * inverse[starts] + counts.astype(np.uint64))


def _pieces(shared, batches: Iterator[pa.RecordBatch]):
    """Segments of documents; ``shared`` has all kept anchors, or is None where each document comes with its own."""
    every = Chosen(*shared.value) if shared else None
    for batch in batches:
        ids = batch.column(0).to_numpy()
        chosen = every or ChosenByDocument(batch)
        for first, texts in _grouped(batch):
            words, segments = _segments(chosen, first, texts)
            if segments:
                document, starts, counts, key = segments
                marks = np.array([_mark(t) for t in texts], np.int32)
                yield ids[document + first], marks[document], words, document, starts, counts, key


def _contents(shards: int, shared):
    """Kernel: distinct segments per group of texts, packed by shard: (shard, keys, first and last doc_ids, counts, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, words, _, starts, counts, key in _pieces(shared, batches):
            content = _segment_keys(words, starts, counts)
            order = np.lexsort((ids, content))
            new = np.append(True, content[order][1:] != content[order][:-1])
            begin = np.flatnonzero(new)
            one = order[begin]
            least, most = ids[one], ids[order[np.append(begin[1:], len(order)) - 1]]
            shard = (_mixed(key[one]) % np.uint64(shards)).astype(np.int64)
            rows = []
            by = np.argsort(shard, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1):
                n = counts[one[part]]
                lengths = n + WINDOW - 1
                flat = np.repeat(starts[one[part]] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                short = words.hashes[flat].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
                arrays = (content[one[part]], least[part], most[part], n.astype(np.int32), short)
                rows.append((int(shard[part[0]]), *(a.tobytes() for a in arrays)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 5))],
                ["shard", "content", "least", "most", "counts", "words"],
            )

    return run


def _places(shared):
    """Kernel: where every segment stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, marks, words, document, starts, counts, _ in _pieces(shared, batches):
            content = _segment_keys(words, starts, counts).view(np.int64)
            columns = (content, ids, marks, (starts - words.first[document]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["content", "doc_id", "mark", "start"])

    return run


class WaveletMatrix:
    """Rank queries over a sequence of small integers: one packed bit vector and its block counts per bit."""

    def __init__(self, values: np.ndarray, largest: int) -> None:
        self.levels = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view("<u8")
            before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            zeros = len(values) - int(before[-1])
            self.levels.append((bit, packed, before, zeros))
            values = np.concatenate((values[ones == 0], values[ones == 1]))

    def rank(self, symbols: np.ndarray, at: np.ndarray, origin: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position ``at``; origin: where its occurrences begin at the last level."""
        for bit, packed, before, zeros in self.levels:
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(packed[block] & mask)
            at = np.where((symbols >> bit) & 1, zeros + ones, at - ones)
        return at - origin

    def origins(self, symbols: np.ndarray) -> np.ndarray:
        return self.rank(symbols, np.zeros(len(symbols), np.int64), np.int64(0))


class FmIndex:
    """FM-index of segments given as word hashes, each followed by an end symbol.

    Suffixes are sorted by their first 16 symbols, which is exact for patterns of up to 15.
    """

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray) -> None:
        distinct, coded = np.unique(hashes, return_inverse=True)
        ends = np.cumsum(lengths + 1) - 1
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = coded + 1
        self.text, self.begin = text, ends - lengths
        order = rank = None
        for step in (0, 1, 2, 4, 8):
            if step == 0:
                key = text
            else:
                key = rank * (rank.max() + 2)
                key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            changes = np.concatenate(([0], np.diff(key[order]) != 0))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(changes)
        self.suffixes = order
        self.matrix = WaveletMatrix(text[order - 1], len(distinct))
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(distinct) + 1))))
        self.origin = self.matrix.origins(np.arange(len(distinct) + 1))

    def intervals(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval of the words at each position; a search ends early once only one suffix is left."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.text), np.int64)
        live = np.arange(len(at))
        for j in range(length - 1, -1, -1):
            symbol = self.text[at[live] + j]
            origin, base = self.origin[symbol], self.smaller[symbol]
            low[live] = base + self.matrix.rank(symbol, low[live], origin)
            high[live] = base + self.matrix.rank(symbol, high[live], origin)
            live = live[high[live] - low[live] > 1]
        return low, high


def first_documents(hashes: np.ndarray, counts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every window of every segment, the smallest document of a segment that holds the window."""
    lengths = counts.astype(np.int64) + WINDOW - 1
    index = FmIndex(hashes, lengths)
    at = np.repeat(index.begin - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    owner = np.repeat(np.arange(len(counts)), counts)
    low, high = index.intervals(at, WINDOW)
    found = least[owner]
    shared = np.flatnonzero(high - low > 1)
    if len(shared):
        bounds, back = np.unique(low[shared] * (len(index.text) + 1) + high[shared], return_inverse=True)
        edges = np.stack(np.divmod(bounds, len(index.text) + 1), axis=1).ravel()
        segment = np.repeat(np.arange(len(counts)), lengths + 1)
        by_suffix = np.append(least[segment[index.suffixes]], np.iinfo(np.int64).max)
        found[shared] = np.minimum.reduceat(by_suffix, edges)[::2][back]
    return found


def _search(_, shard):
    """Kernel: the FM-index of one shard answers all its windows; only segments with something to remove are returned."""
    parts = [np.frombuffer(b"".join(x.as_py() for x in shard[name]), kind) for name, kind in
             (("content", np.uint64), ("least", np.int64), ("most", np.int64), ("counts", np.int32), ("words", np.uint8))]
    content, least, most, counts, short = parts
    hashes = np.zeros((len(short) // WORD_BYTES, 8), np.uint8)
    hashes[:, :WORD_BYTES] = short.reshape(-1, WORD_BYTES)
    hashes = hashes.view("<u8")[:, 0]
    keys, one, back = np.unique(content, return_index=True, return_inverse=True)
    low, top = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, back, least)
    np.maximum.at(top, back, most)
    lengths = counts.astype(np.int64) + WINDOW - 1
    begin = (np.cumsum(lengths) - lengths)[one]
    counts, lengths = counts[one].astype(np.int64), lengths[one]
    flat = np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    found = first_documents(hashes[flat], counts, low)
    edges = np.cumsum(counts) - counts
    useful = np.minimum.reduceat(found, edges) < top
    values = found[np.repeat(useful, counts)]
    offsets = np.concatenate(([0], np.cumsum(counts[useful]))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
    return pa.table({"content": pa.array(keys[useful].view(np.int64)), "firsts": lists})


def repeated_windows(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, found): for the texts of each doc_id, (mark of the text, words at which a window starts that a smaller doc_id has too).

    ``docs`` has doc_id (long, not null), then columns to carry, then text (not null).
    """
    limit = SENT_ANCHORS if limit is None else limit
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    shards = 1 + size // SHARD_BYTES
    anchors = docs.select("doc_id", "text").mapInArrow(returning(_document_anchors), "anchor long, doc_id long")
    kept = (
        anchors.groupBy("anchor")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
        .where("least < most")
        .selectExpr("anchor", f"n > {SHARED} AS hot")
    )
    kept = staged(kept)
    if kept.count() <= limit:
        rows = kept.orderBy("anchor").toArrow()
        values = (rows["anchor"].to_numpy(), rows["hot"].to_numpy(zero_copy_only=False).astype(bool))
        shared, chosen = docs.sparkSession.sparkContext.broadcast(values), docs.select("doc_id", "text")
    else:
        lists = (
            anchors.join(kept, "anchor")
            .groupBy("doc_id")
            .agg(F.collect_list("anchor").alias("kept"), F.collect_list(F.expr("CASE WHEN hot THEN anchor END")).alias("hot"))
        )
        shared, chosen = None, docs.join(lists, "doc_id").select("doc_id", "kept", "hot", *docs.columns[1:])
    packed = "shard long, content binary, least binary, most binary, counts binary, words binary"
    # a segment is in one shard only, so its key is unique here; without an aggregate between shuffle and
    # join, adaptive execution can split the places of a segment that very many documents share
    found = chosen.mapInArrow(returning(_contents(shards, shared)), packed).groupBy("shard").applyInArrow(_search, "content long, firsts array<long>")
    placed = chosen.mapInArrow(returning(_places(shared)), "content long, doc_id long, mark int, start int")
    hits = placed.join(found, "content").selectExpr(
        "doc_id", "mark", "filter(transform(firsts, (f, i) -> IF(f < doc_id, start + i, -1)), s -> s >= 0) AS starts"
    )
    return hits.where("size(starts) > 0").groupBy("doc_id").agg(F.collect_list(F.struct("mark", "starts")).alias("found"))


def _removed(n: int, starts: np.ndarray) -> np.ndarray:
    """Mask of the words covered by windows at ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return np.cumsum(edges[:n]) > 0


def _kept(fields: list[str], layout: bool):
    """Kernel over (doc_id, found, carried columns, text): adds n_words, n_removed and the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, removed, kept = [], [], []
            for found, value in zip(batch.column(1), batch.column(batch.num_columns - 1)):
                text = value.as_py().encode()
                tokens = text.split()
                words.append(len(tokens))
                mark = _mark(text) if found.is_valid else 0
                starts = [s for x in found.as_py() or () if x["mark"] == mark for s in x["starts"]]
                removed.append(0)
                if starts:
                    gone = _removed(len(tokens), np.array(starts))
                    removed[-1] = int(gone.sum())
                    tokens = [t for t, g in zip(tokens, gone.tolist()) if not g]
                kept.append(text if layout and not starts else b" ".join(tokens))
            new = [pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:-1], *new], fields)

    return run


def dedup_substrings(docs: DataFrame, carried: tuple[str, ...] = (), layout: bool = False) -> DataFrame:
    """doc_id, the ``carried`` columns, n_words, n_removed and kept (words joined by a space), one row per row of ``docs``.

    A word goes if a window of 13 words over it also starts in a document with a smaller doc_id (long).
    Null texts count as empty; a row without doc_id is smaller than none and keeps all words; rows of
    one doc_id don't affect each other.  Texts under 13 words keep all.  With ``layout`` a text that
    keeps all words keeps its white space too.  Columns neither named nor carried are ignored.
    """
    inner = [f"carried_{i}" for i in range(len(carried))]
    rows = docs.select("doc_id", *[F.col(c).alias(i) for c, i in zip(carried, inner)], text_or_empty().alias("text"))
    named = rows.where("doc_id IS NOT NULL")
    # no cast or alias of doc_id here: this join and the one inside then share one shuffle of the texts
    marked = repeated_windows(named).join(named, "doc_id", "right").select("doc_id", "found", *inner, "text")
    empty = F.lit(None).cast("array<struct<mark: int, starts: array<int>>>")
    rest = rows.where("doc_id IS NULL").select("doc_id", empty.alias("found"), *inner, "text")
    fields = ["doc_id", *inner, "n_words", "n_removed", "kept"]
    kinds = ["long", *[rows.schema[i].dataType.simpleString() for i in inner], "long", "long", "string"]
    found = marked.unionAll(rest).mapInArrow(returning(_kept(fields, layout)), ", ".join(f"{n} {k}" for n, k in zip(fields, kinds)))
    return found.toDF("doc_id", *carried, "n_words", "n_removed", "kept")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from their texts; n_chars, if there, is counted anew for texts that changed."""
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = dedup_substrings(docs, carried, layout=True)
    names = [f"c{i}" for i in range(len(carried))]
    found = found.toDF("doc_id", *names, "n_words", "n_removed", "kept")
    columns = dict(zip(carried, map(F.col, names))) | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in columns:
        chars = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(columns["n_chars"])
        columns["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
