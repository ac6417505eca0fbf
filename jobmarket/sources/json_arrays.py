"""Records of files that each hold one JSON array, however large the files are.

A file is read as text that ends at every ``}``, so Spark splits it into byte ranges like any text file,
wherever it is stored.  What a range starts with (inside a string, inside a record, after how many records)
depends on all ranges before it.  So the ranges are read twice:

1. every range is summed up for both cases, starting outside and inside a string; folding these sums file by
   file, one row per range, tells how every range starts;
2. with that known, every range yields its whole records, with their numbers.  What is left at its ends are
   pieces of records that lie in several ranges; only these are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmarket.session import ship
from jobmarket.sources.staging import staged

_ESCAPES = re.compile(r"\\.", re.DOTALL)
_STRINGS = re.compile(r'"[^"]*(?:"|\Z)')
_REST_OF_STRING = re.compile(r'\A[^"]*(?:"|\Z)')
_BRACKETS = str.maketrans({c: None for c in map(chr, range(128)) if c not in "[]{}"})
_FIRST = re.compile(r"\A[ \t\r\n]*\[[ \t\r\n]*\Z")
_NEXT = re.compile(r"\A[ \t\r\n]*,[ \t\r\n]*\Z")
_LAST = re.compile(r"\A[ \t\r\n]*\][ \t\r\n]*\Z")
_EMPTY = re.compile(r"\A[ \t\r\n]*\[[ \t\r\n]*\][ \t\r\n]*\Z")


class Scan:
    """Where a scan stands: inside a string or not, and how deep in brackets."""

    __slots__ = ("depth", "inside")

    def __init__(self, inside: bool, depth: int) -> None:
        self.inside, self.depth = inside, depth

    def add(self, segment: str) -> bool:
        """Go on by a segment that ends with a brace; whether that brace ends an object."""
        if "\\" in segment:
            segment = _ESCAPES.sub("", segment)
        if self.inside:
            rest = _REST_OF_STRING.sub("", segment, count=1)
            closed = len(rest) < len(segment) and segment[len(segment) - len(rest) - 1] == '"'
            if not closed:
                return False
            segment = rest
        self.inside = segment.count('"') % 2 == 1
        outside = _STRINGS.sub("", segment).translate(_BRACKETS)
        self.depth += outside.count("{") + outside.count("[") - outside.count("}") - outside.count("]")
        return not self.inside


def _by_range(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Consecutive rows of equal first columns, as (first columns, values of the last column)."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        key = row[:keys]

        def values() -> Iterator[str]:
            nonlocal row
            while row is not None and row[:keys] == key:
                yield row[-1]
                row = next(rows, None)

        found = values()
        yield key, found
        for _ in found:
            pass


_SUMS = "file string, start long, alone boolean, last string, outside struct<inside boolean, depth long, last_inside boolean, last_depth long, closed map<long, long>>"
_SUMS += _SUMS[_SUMS.index(", outside") :].replace("outside", "inside", 1)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, value), in file order, to the sums of every range.

    ``closed`` counts the ends of objects by the depth they lead back to, from the start of the range.  The last
    segment of a file has no brace, so the state before a range's last segment is told too.
    """
    names = ("inside", "depth", "last_inside", "last_depth", "closed")
    for (file, start), values in _by_range(batches, 2):
        scans = [(Scan(inside, 0), {}) for inside in (False, True)]
        before, last, n = [(False, 0), (True, 0)], "", 0
        for last in values:
            n += 1
            before = [(s.inside, s.depth) for s, _ in scans]
            for scan, closed in scans:
                if scan.add(last + "}"):
                    closed[scan.depth] = closed.get(scan.depth, 0) + 1
        sums = [dict(zip(names, (s.inside, s.depth, *b, list(c.items())))) for (s, c), b in zip(scans, before)]
        kind = pa.struct([("inside", pa.bool_()), ("depth", pa.int64()), ("last_inside", pa.bool_()), ("last_depth", pa.int64()), ("closed", pa.map_(pa.int64(), pa.int64()))])
        columns = [pa.array([file]), pa.array([start]), pa.array([n == 1]), pa.array([last]), *(pa.array([s], kind) for s in sums)]
        yield pa.RecordBatch.from_arrays(columns, ["file", "start", "alone", "last", "outside", "inside"])


def _starts(ranges: pa.Table) -> pa.Table:
    """Sums of the ranges of one file to (file, start, in_string, depth, records, ends) of each; nothing if its brackets don't pair."""
    rows = ranges.sort_by("start").to_pylist()
    inside, depth, records, out = False, 0, 0, []
    for row in rows:
        out.append((row["file"], row["start"], inside, depth, records, False))
        sums = row["inside" if inside else "outside"]
        tail = (sums["last_inside"], depth + sums["last_depth"])
        records += dict(sums["closed"]).get(1 - depth, 0)
        inside, depth = sums["inside"], depth + sums["depth"]
    last = rows[-1]
    whole = tail == (False, 1) and _LAST.match(last["last"]) or len(rows) == 1 and last["alone"] and _EMPTY.match(last["last"])
    out = [*out[:-1], (*out[-1][:-1], True)] if whole else []
    columns = zip(*out) if out else [()] * 6
    types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "start", "in_string", "depth", "records", "ends"])


_PIECES = "file string, ord long, start long, whole boolean, piece string, apart boolean"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments, with the state their range starts with, to records and pieces of records.

    ``apart`` tells whether a record is set apart from the one before it as an array asks for.
    """
    names = ("file", "ord", "start", "whole", "piece", "apart")
    types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

    out: list[tuple] = []
    size = 0
    for (file, start, in_string, depth, ord_, ends), values in _by_range(batches, 6):
        if ord_ is None:
            raise ValueError(f"{file}: byte ranges changed between two reads of it; set spark.sql.files.minPartitionNum")
        scan, whole, apart = Scan(in_string, depth), depth < 2, True
        parts: list[str] = []
        held = next(values, None)
        while held is not None:
            value, held = held, next(values, None)
            if held is None and ends:
                break  # the end of the array
            if not parts and whole:
                lead, brace, rest = value.partition("{")
                apart = bool(brace) and bool((_NEXT if ord_ else _FIRST).match(lead))
                if scan.depth == 0:
                    scan.depth = 1 if apart else 0
                value = brace + rest if apart else value
            parts.append(value + "}")
            if scan.add(parts[-1]) and scan.depth == 1:
                out.append((file, ord_, start, whole, "".join(parts), apart))
                size += sum(map(len, parts))
                parts, whole, ord_ = [], True, ord_ + 1
                if size > 1 << 22 or len(out) >= 10_000:
                    yield batch(out)
                    out, size = [], 0
        if parts:
            out.append((file, ord_, start, False, "".join(parts), apart))
    if out:
        yield batch(out)


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.json") -> DataFrame:
    """(file_name, ord, and the columns of ``schema``): the objects of every array, numbered from 0.

    Files whose content is no valid JSON array of objects yield nothing; a byte-order mark is skipped.  Every file is read twice: to find
    where ranges start, and for its records.  These are written to the shared folder when this is called, as a file's
    records count only once all of them are known to be valid.
    """
    ship(spark)
    segments = spark.read.option("pathGlobFilter", glob).option("lineSep", "}").text(path)
    segments = segments.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    state = "file string, start long, in_string boolean, depth long, records long, ends boolean"
    starts = segments.mapInArrow(_summed, _SUMS).groupBy("file").applyInArrow(_starts, state)
    files = starts.select("file").distinct()
    known = segments.join(F.broadcast(files), "file")  # a row per file
    known = known.join(F.broadcast(starts), ["file", "start"], "left")  # a row per byte range
    pieces = known.select("file", "start", "in_string", "depth", "records", "ends", "value").mapInArrow(_pieces, _PIECES)
    pieces = staged(pieces, "pieces")
    joined = (
        pieces.where("NOT whole").groupBy("file", "ord")
        .agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(start, piece))), p -> p.piece)"), "").alias("piece"), F.bool_and("apart").alias("apart"))
    )
    records = pieces.where("whole").select("file", "ord", "piece", "apart").unionAll(joined)
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = records.select("file", "ord", "apart", F.from_json("piece", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = parsed.where("NOT apart OR r IS NULL OR r._corrupt IS NOT NULL").select("file").distinct()
    kept = parsed.join(F.broadcast(bad), "file", "left_anti")  # at most a row per file
    name = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))
    return kept.select(name.alias("file_name"), F.col("ord").cast("int").alias("ord"), *[F.col(f"r.{f.name}").alias(f.name) for f in schema])
