"""Quartile bucket digests: locality-sensitive fingerprints of documents.

A digest counts hashed byte triplets, the bytes at i, i + 2 and i + 5, in 256 buckets, and writes
for each bucket in which quartile of all bucket counts it lies (2 bits), with a code of the length
in front.  The n-th occurrence of a triplet is hashed together with n: without that the frequent
triplets of a language, which all its texts share, would decide most quartiles.

Two digests are compared by the sum of the differences of their quartiles and of their length
codes, bounded by what unrelated texts have on average; the likeness falls from 1 to 0 over it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, need, shuffle_partitions

BUCKETS, STEPS = 256, (2, 5)
UNRELATED = 1.25 * BUCKETS  # the mean of |a - b| over quartiles a, b that are independent is 1.25
LENGTH_STEP, LENGTH_WEIGHT = 1.5, 4
PARTS_A_TASK = 8


def quartile_codes(raw: bytes) -> np.ndarray:
    """The quartile, 0 to 3, of each bucket's count; all 0 for fewer than six bytes."""
    a, b = STEPS
    x = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    n = len(x) - b
    if n <= 0:
        return np.zeros(BUCKETS, dtype=np.uint8)
    c = (x[:n] << 16) | (x[a : a + n] << 8) | x[b:]
    c.sort()
    at = np.arange(n)
    first = np.ones(n, dtype=bool)
    np.not_equal(c[1:], c[:-1], out=first[1:])
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    h = c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nth.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    counts = np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
    q = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))
    return sum((counts > q[k * BUCKETS // 4 - 1]).astype(np.uint8) for k in (1, 2, 3))


def digest(text: str | None) -> str:
    """``Q1``, two hex digits of the length code, 128 of the quartiles.  Null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    code = quartile_codes(raw).reshape(-1, 4)
    packed = code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]
    length = int(np.log(len(raw) + 1) / np.log(LENGTH_STEP))
    return f"Q1{length:02x}{packed.astype(np.uint8).tobytes().hex()}"


def _read(fingerprint: str) -> tuple[int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(fingerprint[4:]), dtype=np.uint8)
    return int(fingerprint[2:4], 16), np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel().astype(np.int16)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from the bound of the difference on."""
    if a == b:
        return 1.0
    (m, x), (n, y) = _read(a), _read(b)
    return float(1 - min(UNRELATED, np.abs(x - y).sum() + LENGTH_WEIGHT * abs(m - n)) / UNRELATED)


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``n_chars`` (code points) and ``fingerprint`` of every whole text."""
    need(docs, id_column, text_column)
    bounded_batches(docs.sparkSession, 256, 4 << 20)
    schema = T.StructType([docs.schema[id_column], T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(digest, texts), pa.string())], names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def _in_order(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (part, ahead, id, tie, body) so that each part holds a range of ids, sorted, and then,
    with ``ahead`` = 1, the rows that begin the next part (for the last part, the first)."""
    spark = docs.sparkSession
    parts = PARTS_A_TASK * shuffle_partitions(spark)
    ids = F.col(id_column)
    fractions = [k / parts for k in range(1, parts)]
    least, nulls, at = docs.agg(F.min(ids), F.count_if(ids.isNull()), F.percentile_approx(ids, fractions, 50 * parts)).first()
    bounds = np.array(sorted(set(at or ()) - {least}), dtype=np.int64)
    begins = set(bounds.tolist())
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("ahead", T.IntegerType()), ("id", kind), ("tie", T.LongType()), ("body", T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            row, part, ahead, tie, body = [], [], [], [], []
            for i, (key, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                own = 0 if key is None else int(np.searchsorted(bounds, key, side="right"))
                places = [(own, 0)]
                if key is not None and key in begins:
                    places.append((own - 1, 1))
                if key is None or (not nulls and key == least):
                    places.append((len(bounds), 1))
                packed, crc = squeeze(raw), zlib.crc32(raw)
                for p, a in places:
                    row.append(i), part.append(p), ahead.append(a), tie.append(crc), body.append(packed)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(ahead, pa.int32()), batch.column(0).take(pa.array(row, pa.int64())), pa.array(tie, pa.int64()), pa.array(body, pa.binary())], names=schema.names)

    placed = docs.select(ids, text_column).mapInArrow(run, schema)
    return placed.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "ahead", "id", "tie")


def compare_with_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: int = 4) -> DataFrame:
    """Fingerprint every text, its edit, and compare it with the edit and with the next text.

    The edit replaces the last floor(n / ``share``) code points by as many first ones (or all) of
    the next document in the order of ids; the last is followed by the first.  Returns
    ``id_column``, ``n_chars``, ``edited`` (the text), ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``.

    Ids are integers; nulls come first, equal ids in the order of their texts' checksum.  A null
    text is empty.  The whole texts are dealt once, by ranges of ids; what follows a range's last
    document is sent to it as well, so no task waits for another.
    """
    need(docs, id_column, text_column)
    if not isinstance(docs.schema[id_column].dataType, T.IntegralType):
        raise ValueError(f"{id_column} is {docs.schema[id_column].dataType.simpleString()}, not an integer")
    bounded_batches(docs.sparkSession, 256, 4 << 20)
    strings = ("edited", "fingerprint", "edited_fingerprint")
    schema = T.StructType([docs.schema[id_column], T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in strings), *(T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next"))])
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        before = None  # (part, id, text, fingerprint), still waiting for its successor
        for batch in batches:
            rows = []
            for part, ahead, key, body in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if ahead and (before is None or before[0] != part):
                    continue  # another row that begins the next part
                text = unpack(body).decode("utf-8", "surrogatepass")
                mark = digest(text)
                if before is not None:
                    _, was, old, old_mark = before
                    k = len(old) // share
                    edited = old[: len(old) - k] + text[:k]
                    new_mark = digest(edited)
                    rows.append((was, len(old), edited, old_mark, new_mark, likeness(old_mark, new_mark), likeness(old_mark, mark)))
                before = None if ahead else (part, key, text, mark)
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t or batch.schema.field(2).type) for c, t in zip(columns, kinds, strict=True)], names=schema.names)
        if before is not None:
            raise ValueError(f"nothing follows document {before[1]}")

    return _in_order(docs, id_column, text_column).mapInArrow(run, schema)


def op9_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edits."""
    out = compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
