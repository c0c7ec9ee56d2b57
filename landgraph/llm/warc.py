"""WARC archives: a writer with revisit records and a splittable reader.

``write_archives`` writes one gzip member for each record.  Of records with equal payloads of at
least ``MIN_REVISIT`` bytes the one with the largest id carries the payload; the others become
revisit records that refer to it.

``read_archives`` reads any byte range of an archive on its own: it looks for the bytes that begin
a gzip member, takes a place for a record only if the member there decodes to a WARC header, and
returns the records that begin in its range, reading beyond the range's end to finish the last.
Every record is so owned by exactly one task, however the ranges are cut.

Archives lie in a folder that all machines reach by a URI; they are opened with ``pyarrow.fs``.
A task writes files of a fresh name and reports them in its result, so what a lost or repeated
task has left behind is never read.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, need, shared_root, stage

MIN_REVISIT, FILE_BYTES, SPLIT_BYTES, READ_BYTES = 1000, 256 << 20, 16 << 20, 1 << 18
#: Fixed strings of the format.
MAGIC, VERSION, BEGINS = b"\x1f\x8b\x08", b"WARC/1.1", b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("declared_bytes", T.LongType()),
        T.StructField("declared_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe='%:/?#[]@!$&()*+,;=~', errors='replace')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    raw = VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def with_revisits(pages: DataFrame, id_column: str = "page_id", text_column: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Add ``payload``, ``digest`` (SHA-1) and ``refers_to``, null for what is to be a response.

    Equal payloads are told by SHA-256.  Counts and largest ids are combined before they are
    shuffled; only ids and digests are joined by payload (a join of which Spark splits large
    groups), and payloads move once, by id.
    """
    payload = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    pages = pages.withColumn("payload", payload)
    keyed = pages.where(F.length("payload") >= least).select(F.col(id_column).alias("_id"), F.sha2("payload", 256).alias("_key"))
    first = keyed.groupBy("_key").agg(F.max("_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    revisits = keyed.where("_id is not null").join(first, "_key").where("_id <> refers_to").distinct()
    whole = pages.withColumns({"digest": F.unhex(F.sha1("payload")), "_key": F.sha2("payload", 256)})
    same = (whole[id_column] == revisits["_id"]) & (whole["_key"] == revisits["_key"])
    return whole.join(revisits, same, "left").drop("_id", "_key")


def write_archives(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url", text_column: str = "html", date: str = "2020-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all rows as records; returns the table of archives (path, bytes, records).

    A null text is an empty payload, a null URL leaves the target out, a null id is written as
    none (and is never referred to).  Rows that repeat the largest id of equal payloads are all
    responses.  No rows, no archives.
    """
    need(pages, id_column, url_column, text_column)
    spark = pages.sparkSession
    bounded_batches(spark, 256, 4 << 20)
    folder = folder or f"{shared_root(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _place(folder)
        files.create_dir(base, recursive=True)
        done, sink, name, size, count = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink = files.open_output_stream(f"{base}/{name}", compression=None)
                raw = record(page_id, url, payload, digest, refers_to, date)
                sink.write(raw)
                size, count = size + len(raw), count + 1
                if size >= file_bytes:
                    sink.close()
                    done.append((f"{folder}/{name}", size, count))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((f"{folder}/{name}", size, count))
        columns = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=ARCHIVES.names)

    rows = with_revisits(pages.select(id_column, url_column, text_column), id_column, text_column)
    rows = rows.select(F.col(id_column).cast("long"), url_column, "payload", "digest", F.col("refers_to").cast("long"))
    return stage(rows.mapInArrow(run, ARCHIVES), "warc-archives")


class _Source:
    """A file read forward from any place."""

    def __init__(self, handle, size: int):
        self.handle, self.size = handle, size

    def at(self, offset: int, n: int) -> bytes:
        self.handle.seek(offset)
        return self.handle.read(min(n, self.size - offset))

    def find(self, start: int, end: int) -> int | None:
        """The first place in [start, end) where a gzip member may begin."""
        while start < end:
            part = self.at(start, min(READ_BYTES, end - start) + len(MAGIC) - 1)
            k = part.find(MAGIC)
            if k >= 0 and start + k < end:
                return start + k
            start += READ_BYTES
        return None

    def begins_record(self, offset: int) -> bool:
        try:
            return zlib.decompressobj(31).decompress(self.at(offset, 4096), 64).startswith(BEGINS)
        except zlib.error:
            return False

    def member(self, offset: int) -> tuple[bytes, int]:
        """The content of the member at ``offset`` and where it ends."""
        unpack, out, at = zlib.decompressobj(31), [], offset
        while not unpack.eof:
            part = self.at(at, READ_BYTES)
            if not part:
                raise ValueError(f"a record at {offset} is cut off")
            out.append(unpack.decompress(part))
            at += len(part)
        return b"".join(out), at - len(unpack.unused_data)


def _number(uri: str) -> int | None:
    text = uri.strip("<>").rpartition(":")[2]
    return int(text) if text else None


def parse(raw: bytes) -> tuple:
    """(page_id, type, target, refers_to, declared bytes, declared digest, payload) of a record."""
    end = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    if len(raw) != end + 8 + len(block):
        raise ValueError(f"{head['WARC-Record-ID']}: its length is not what its header says")
    split = block.index(b"\r\n\r\n") + 4
    http = dict(line.split(": ", 1) for line in block[: split - 4].decode().split("\r\n")[1:])
    revisit = head["WARC-Type"] == "revisit"
    digest = base64.b32decode(head["WARC-Payload-Digest"].partition(":")[2]).hex()
    refers_to = _number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
    return _number(head["WARC-Record-ID"]), head["WARC-Type"], head.get("WARC-Target-URI"), refers_to, int(http["Content-Length"]), digest, None if revisit else block[split:]


def records_of(source: _Source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that begin in [start, end)."""
    at = start
    while at is not None and at < end:
        if (at := source.find(at, end)) is None:
            return
        if source.begins_record(at):
            raw, after = source.member(at)
            yield at, raw
            at = after
        else:
            at += 1


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives (path, bytes), one row each, read in ranges of ``split_bytes``.

    ``payload`` is null for revisits; ``declared_bytes`` and ``declared_digest`` are those of the
    headers, for revisits of the payload they refer to.  A record that is cut off or whose length
    is wrong raises an error.
    """
    spark = archives.sparkSession
    bounded_batches(spark, 256, 4 << 20)
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    total = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, place = _place(path)
                rows, held = [], 0
                with files.open_input_file(place) as handle:
                    for offset, raw in records_of(_Source(handle, size), start, min(size, start + split_bytes)):
                        rows.append((*parse(raw), path, offset))
                        held += len(raw)
                        if held >= 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    return ranges.repartition(max(1, min(int(total), 100_000)), "path", "start").mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=RECORDS.names)


def op8_warc_archives(spark, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    records = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return records.select(
        "page_id",
        F.coalesce(F.length("payload").cast("long"), F.col("declared_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP8_SQL = """
SELECT page_id, octet_length(p) AS payload_bytes, sha1(p) AS payload_digest,
       CASE WHEN octet_length(p) >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(p) >= 1000 AND page_id < top THEN top END AS refers_to
FROM (SELECT page_id, p, max(page_id) OVER (PARTITION BY p) AS top
      FROM (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages))
"""
