"""Deterministic sharded WARC writer and reader.

Records are ordered by page_id and cut into shards of equal payload size; the cuts come from exact
prefix sums, so they depend on the data alone.  A task writes the files of its shards one after the
other, starts a new file when the compressed size reaches a limit, and computes every header and
digest anew.  A file is written under a name of its own attempt and then renamed; rows of the
manifest come from attempts that succeeded, and readers open only what the manifest lists.

Files go through ``pyarrow.fs`` to the URI given, which executors must be able to reach.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobmarket.llm.common import MOST_TASKS, prefix_sums, range_cuts, staged, table, text_or_empty, work_path

#: payloads shorter than this are always stored
LEAST_REVISIT = 100
#: payload bytes of a shard, and compressed bytes after which a file is closed
SHARD_BYTES = 8 << 20
FILE_BYTES = 64 << 20
#: bytes that a record without payload counts for
RECORD_BYTES = 512
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard long, file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, compressed as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _urn(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else " ".join(url.split()),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Page-ID": page_id,
        "Payload-Length": len(payload),
    }
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = _urn(refers_to, digest)
        head["Refers-To-Page-ID"] = refers_to
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return _member(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _info(name: str) -> bytes:
    block = b"software: jobmarket\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_urn(None, name)}\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\n"
    return _member(head.encode() + b"Content-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n")


class _Files:
    """The files of one shard."""

    def __init__(self, root: str, shard: int, limit: int) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.limit, self.number, self.stream = shard, limit, 0, None

    def write(self, data: bytes) -> list[tuple]:
        closed = self.close() if self.stream and self.bytes + len(data) > self.limit else []
        if not self.stream:
            self.name = f"{self.shard:08d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.root}/_temporary-{uuid.uuid4().hex}-{self.name}"
            self.stream = self.fs.open_output_stream(self.temporary, compression=None)
            self.bytes, self.records, self.digest = 0, -1, hashlib.sha256()
            self._put(_info(self.name))
        self._put(data)
        return closed

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> list[tuple]:
        if not self.stream:
            return []
        self.stream.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")
        self.stream, self.number = None, self.number + 1
        return [(self.shard, self.name, self.records, self.bytes, self.digest.hexdigest())]


def _writer(root: str, limit: int):
    """Kernel over rows sorted by (shard, page_id, kind): decisions (kind 0) come before the pages they are about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, page, decided = None, (), {}
        for batch in batches:
            done = []
            for row in zip(*(c for c in batch.columns)):
                shard, page_id, kind, digest, refers_to, url, html = (x.as_py() for x in row)
                if files is None or files.shard != shard:
                    done += files.close() if files else []
                    files = _Files(root, shard, limit)
                if page != (shard, page_id):
                    page, decided = (shard, page_id), {}
                if kind == 0:
                    decided[digest] = refers_to
                else:
                    payload = html.encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    done += files.write(record(page_id, url, payload, digest, decided[digest]))
            yield _manifest(done)
        yield _manifest(files.close() if files else [])

    return run


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "file", "records", "bytes", "sha256"])


def decisions(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes, refers_to) per row of ``pages`` (page_id, html not null): refers_to is null for a response.

    Counts per payload are aggregated before the shuffle; the join to them has no texts in it.
    """
    rows = pages.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    first = rows.where(f"bytes >= {LEAST_REVISIT}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    joined = rows.join(first.where("n > 1").select("digest", "first"), "digest", "left")
    return joined.selectExpr("page_id", "digest", "bytes", "CASE WHEN NOT (page_id <=> first) THEN first END AS refers_to")


def _shard_starts(rows: DataFrame, shard_bytes: int) -> list[int]:
    """Smallest page_id of every shard but the first, from exact prefix sums of sizes in page_id order."""
    known = rows.where("page_id IS NOT NULL")
    cuts = range_cuts(known, "page_id", 64)
    part = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("page_id"))) if cuts else F.lit(0)
    sized = known.groupBy("page_id").agg(F.sum(F.col("bytes") + RECORD_BYTES).alias("size")).withColumn("part", part)
    totals = prefix_sums(sized.groupBy("part").agg(F.sum("size").alias("in_part")), "part", "in_part", "start")
    before = Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(F.broadcast(totals), "part").withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    starts = placed.groupBy(F.expr(f"before div {shard_bytes}").alias("shard")).agg(F.min("page_id").alias("first")).orderBy("first")
    return [r["first"] for r in starts.collect()][1:]


def write_warc(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) below ``root``; returns the manifest, also stored there.

    A payload of at least 100 bytes is stored with the smallest page_id that has it; other pages get a
    revisit record.  A null html is an empty payload.  Rows equal in page_id and payload are written
    alike; rows without page_id come first and refer to a page with an id if there is one.  Other
    columns are ignored.  An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_or_empty("html").alias("html"))
    decided = staged(decisions(rows))
    starts = np.array(_shard_starts(decided, shard_bytes), np.int64)

    @F.pandas_udf("long")
    def shard(page_id: pd.Series) -> pd.Series:
        known = page_id.fillna(np.iinfo(np.int64).min).astype(np.int64)
        return pd.Series(np.searchsorted(starts, known.to_numpy(), side="right"))

    empty = F.lit(None).cast("string")
    told = decided.select(shard("page_id").alias("shard"), "page_id", F.lit(0).alias("kind"), "digest", "refers_to", empty.alias("url"), empty.alias("html"))
    full = rows.select(shard("page_id").alias("shard"), "page_id", F.lit(1).alias("kind"), empty.alias("digest"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    both = told.distinct().unionAll(full)
    tasks = min(len(starts) + 1, MOST_TASKS)
    ordered = both.repartitionById(tasks, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "kind")
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return staged(ordered.mapInArrow(_writer(root, file_bytes), MANIFEST), f"{root}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a compressed archive, holding one record at a time."""
    pending, member, data = b"", zlib.decompressobj(31), []
    while chunk := pending or stream.read(1 << 20):
        data.append(member.decompress(chunk))
        pending = member.unused_data
        if member.eof:
            head, _, rest = b"".join(data).partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]
            member, data = zlib.decompressobj(31), []
    if data:
        raise ValueError("the archive ends inside a record")


def _parsed(headers: dict[str, str], block: bytes) -> tuple:
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = headers["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2]
    if hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"damaged block of {headers['WARC-Record-ID']}")
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
    number = lambda name: int(headers[name]) if name in headers else None
    return number("Page-ID"), headers.get("WARC-Target-URI"), number("Payload-Length"), digest, kind, number("Refers-To-Page-ID"), payload


def read_warc(manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """All pages of the files that a manifest lists, digests checked; the payload of a revisit is empty."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    kinds = kinds if payloads else kinds[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, folder = fs.FileSystem.from_uri(root)

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

        for batch in batches:
            for name in batch.column(0):
                rows, size = [], 0
                with place.open_input_stream(f"{folder}/{name.as_py()}", compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(_parsed(headers, block)[: len(kinds)])
                        size += len(block) if payloads else 100
                        if size > 4 << 20:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    # a task per file, the largest first; without a number the few rows of a manifest would end in one task
    place = F.row_number().over(Window.orderBy(F.desc("bytes"), "file"))
    files = manifest.select("file", place.alias("place")).repartitionById(max(1, min(manifest.count(), MOST_TASKS)), "place").select("file")
    return files.mapInArrow(run, RECORD if payloads else RECORD.rpartition(",")[0])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_path(spark)
    manifest = write_warc(table(spark, sf_dir, "pages"), root)
    return read_warc(manifest, root, payloads=False).drop("url")


OP8_SQL = f"""
WITH paid AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages
), sized AS (
    SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM paid
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
    FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""
