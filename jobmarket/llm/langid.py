"""Language identification by cross-parsing.

Every language has a suffix automaton of sampled text.  A text is parsed into the longest phrases that
occur in a language's sample; the fewer phrases, the more alike.  The number of phrases times the
logarithm of the sample's length, per byte, estimates the cross entropy of the text under the language
(Ziv and Merhav); the language with the least wins.

Parsing runs over UTF-8 bytes, with letters in lower case and runs of ASCII characters other than letters as
one blank, so any script works.  A text is cut into pieces of :data:`PIECE` bytes that are parsed
from the root of the automaton, all pieces of a batch in step.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmarket.llm.common import table

#: bytes of sampled text per language at most
TRAIN_BYTES = 48_000
#: documents that a language's sample is taken from, and characters of each of them
TRAIN_DOCS = 400
DOC_CHARS = 1_000
#: bytes of all transition tables together; with very many languages the samples get shorter
TABLE_BYTES = 160_000_000
#: bytes of a piece of text, and pieces that are parsed together
PIECE = 2048
TOGETHER = 4096
UNKNOWN = "und"

_BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def normal(text: str) -> bytes:
    """What is learned and parsed of a text."""
    return b" ".join(text.lower().encode().translate(_BLANKS).split())


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of every state of the automaton of all substrings; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    length, link, last = [0], [-1], 0
    for c in data:
        state, p = len(moves), last
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] != length[p] + 1:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = clone
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                q = clone
            link[state] = q
        last = state
    return moves


class Model:
    """Transition tables of all languages over one alphabet.

    Entry (state, symbol) holds four times the row of the next state plus the number of phrases that
    end: 0 where the automaton goes on; 1 where the symbol starts a new phrase; symbols that the
    language doesn't know are phrases of their own, 2 or, at the root, 1 ends.
    """

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.names = sorted(samples)
        used = sorted(set(b"".join(samples.values())))
        self.symbol = np.full(256, len(used), np.uint8)  # bytes of no sample have no transition
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 1
        limit = TABLE_BYTES // (max(1, len(samples)) * self.width * 4 * 2)
        self.tables, self.weights = [], []
        for name in self.names:
            data = self.symbol[np.frombuffer(samples[name][: max(1, limit)], np.uint8)].tobytes()
            self.tables.append(self._table(suffix_automaton(data)))
            self.weights.append(log2(len(data) + 1))

    def _table(self, moves: list[dict[int, int]]) -> np.ndarray:
        width = self.width
        restart = np.full(width, -1, np.int64)
        for c, s in moves[0].items():
            restart[c] = s
        known = restart >= 0
        first = np.where(known, restart * width * 4 + 1, 2)
        out = np.tile(first, (len(moves), 1))
        out[0] = np.where(known, restart * width * 4, 1)
        state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        symbol = np.fromiter((c for m in moves for c in m), np.int64, len(state))
        out[state, symbol] = np.fromiter((s for m in moves for s in m.values()), np.int64, len(state)) * width * 4
        return out.astype(np.uint32).ravel()

    def phrases(self, data: list[bytes]) -> np.ndarray:
        """Number of phrases of every text (row) in every language (column)."""
        out = np.zeros((len(data), len(self.names)), np.int64)
        pieces = [(i, d[k : k + PIECE]) for i, d in enumerate(data) for k in range(0, len(d), PIECE)]
        pieces.sort(key=lambda p: -len(p[1]))
        for at in range(0, len(pieces), TOGETHER):
            group = pieces[at : at + TOGETHER]
            owner = np.array([i for i, _ in group])
            lengths = np.array([len(p) for _, p in group])
            longest = int(lengths[0])
            padded = b"".join(p.ljust(longest, b"\0") for _, p in group)
            steps = np.ascontiguousarray(self.symbol[np.frombuffer(padded, np.uint8)].reshape(len(group), longest).T)
            active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # pieces longer than the step
            for k, moves in enumerate(self.tables):
                row = np.zeros(len(group), np.uint32)
                ended = np.zeros(len(group), np.int64)
                for symbols, n in zip(steps, active, strict=True):
                    found = moves[row[:n] + symbols[:n]]
                    ended[:n] += found & 3
                    row[:n] = found >> 2
                np.add.at(out[:, k], owner, ended + (row != 0))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of every text.

        The score is the share by which the best language needs fewer normalised phrases than the second, from
        0 (a tie, or no letter) to 1; it is 1 when only one language was learned.  Ties go to the smaller name.
        """
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.names or not rows:
            return names, scores
        data = [normal(texts[i]) for i in rows]
        costs = self.phrases(data) * np.array(self.weights)
        best = costs.argmin(1)
        least = costs[np.arange(len(rows)), best]
        costs[np.arange(len(rows)), best] = np.inf
        second = costs.min(1)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, 1 - least / second)
        for i, b, s in zip(rows, best, score, strict=True):
            names[i], scores[i] = self.names[b], float(s)
        return names, scores


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def samples(docs: DataFrame, limit: int = TRAIN_BYTES) -> dict[str, bytes]:
    """Text of every language, from documents that aren't held out.

    Ids are picked in hash order, at most :data:`TRAIN_DOCS` per language; of each text a part of at most
    :data:`DOC_CHARS` characters is taken, from a place drawn by hash.  At most ``limit`` bytes are kept.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang")
    window = Window.partitionBy("lang").orderBy("order", "doc_id")
    picked = known.withColumn("order", order).withColumn("place", F.row_number().over(window)).where(F.col("place") <= TRAIN_DOCS)
    few = F.broadcast(picked.select("doc_id", "lang", "place", "order").distinct())  # TRAIN_DOCS rows a language
    start = F.pmod(F.col("order"), F.greatest(F.lit(1), F.char_length("text") - DOC_CHARS + 1)).cast("int") + 1
    rows = docs.where(~held_out()).select("doc_id", "lang", "text").join(few, ["doc_id", "lang"])
    rows = rows.select("lang", "place", F.col("text").substr(start, F.lit(DOC_CHARS)).alias("text")).where("text IS NOT NULL")
    found: dict[str, bytearray] = defaultdict(bytearray)
    seen: set[tuple[str, int]] = set()
    for r in rows.orderBy("lang", "place", "text").toLocalIterator():
        if has_letter(r.text) and (r.lang, r.place) not in seen and len(found[r.lang]) < limit:
            seen.add((r.lang, r.place))
            found[r.lang] += normal(r.text) + b" "
    return {lang: bytes(data[:limit]) for lang, data in found.items() if data}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs``, from whole texts alone.

    Null texts and texts without a letter are ``und`` with score 0, and so are all texts when no language
    was learned.  Repeated rows repeat; a null doc_id is not held out.  Other columns are ignored.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TABLE_BYTES

    def grouped(column: pa.Array) -> Iterable[list[str | None]]:
        group, size = [], 0
        for value in column:
            group.append(value.as_py())
            size += len(group[-1] or "")
            if size >= 1 << 22:
                yield group
                group, size = [], 0
        yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for group in grouped(batch.column(2)):
                found = shared.value.predict(group)
                names += found[0]
                scores += found[1]
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op12_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, Model(samples(docs)))
