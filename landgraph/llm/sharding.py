"""Minimax contiguous partition: shards of nearly equal bytes that never split a group.

Rows with equal text form one atomic group.  Groups lie on a line in the order of a 64-bit hash of
the text; the operator finds the smallest capacity C for which the line can be cut into at most
``shards`` contiguous runs of at most C bytes, and cuts there.

The search never gathers the groups.  A first aggregate gives the bytes, the smallest and the
largest hash of 4096 hash ranges.  With these, a greedy walk for a trial capacity is known between
two bounds: it can cut at a known edge (pessimistic), or anywhere within a range of several groups
(optimistic).  Binary search with either walk brackets C.  Only ranges in which a walk may still
cut are then split 256-fold, until both bounds agree, so the driver holds some hundred thousand
cells at most, whatever the input.

Everything here is DataFrame expressions; the driver does arithmetic on the bounded cells.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, need, stage, text_or_empty

FIRST_BITS, MORE_BITS, OVERHEAD = 12, 8, 8


class _Cell:
    """A hash range that holds at least one group; ``atomic`` if it holds just one."""

    __slots__ = ("atomic", "first", "prefix", "size")

    def __init__(self, prefix: int, size: int, first: int, last: int):
        self.prefix, self.size, self.first, self.atomic = prefix, size, first, first == last


def _walk(edges: list[int], atomic: list[bool], cap: int, shards: int, hopeful: bool) -> list[int]:
    """Positions after each of ``shards`` greedy steps from 0."""
    at, total, out = 0, edges[-1], []
    for _ in range(shards):
        to = at + cap
        if to >= total:
            at = total
        else:
            j = bisect_right(edges, to) - 1
            at = to if hopeful and not atomic[j] else edges[j]
        out.append(at)
    return out


def _least(edges: list[int], atomic: list[bool], shards: int, hopeful: bool, low: int) -> int:
    """The smallest capacity from ``low`` with which the walk reaches the end."""
    high = max(low, edges[-1])
    while low < high:
        mid = (low + high) // 2
        if _walk(edges, atomic, mid, shards, hopeful)[-1] == edges[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def minimax_cuts(sized: DataFrame, shards: int, key: str = "k", size: str = "size") -> tuple[int, list[int]]:
    """The smallest feasible capacity and the hashes at which shards 1, 2, ... begin.

    ``sized`` has a signed 64-bit ``key``, equal for the rows of a group, and ``size`` > 0.
    """

    def cells(shift: int, was: int = 64, within: list[int] | None = None) -> list[_Cell]:
        rows = sized if within is None else sized.where(F.shiftright(key, was).isin(within))
        got = rows.groupBy(F.shiftright(key, shift).alias("p")).agg(F.sum(size), F.min(key), F.max(key)).collect()
        return sorted((_Cell(*r) for r in got), key=lambda c: c.first)

    shift = 64 - FIRST_BITS
    line = cells(shift)
    if not line:
        return 0, []
    while True:
        edges, atomic = [0, *accumulate(c.size for c in line)], [c.atomic for c in line]
        floor = max(-(-edges[-1] // shards), max((c.size for c in line if c.atomic), default=1))
        low, high = (_least(edges, atomic, shards, hopeful, floor) for hopeful in (True, False))
        if low == high:
            break
        spans = zip(_walk(edges, atomic, low, shards, False), _walk(edges, atomic, high, shards, True), strict=True)
        split: set[int] = set()
        for a, b in spans:
            j = max(0, bisect_right(edges, a) - 1)
            while j < len(line) and edges[j] <= b:
                if not atomic[j]:
                    split.add(j)
                j += 1
        was, shift = shift, max(0, shift - MORE_BITS)
        finer = cells(shift, was, [line[j].prefix for j in sorted(split)])
        line = sorted([c for j, c in enumerate(line) if j not in split] + finer, key=lambda c: c.first)
    cuts = []
    for at in _walk(edges, atomic, high, shards, False)[:-1]:
        if at >= edges[-1]:
            break
        cuts.append(line[bisect_right(edges, at) - 1].first)
    return high, cuts


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Deal all rows of ``docs`` into shards of nearly equal bytes; equal texts stay together.

    Returns ``id_column``, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``shard``
    (0 to ``shards`` - 1) and ``slot`` (0, 1, ... within the shard).

    A null text counts as empty.  Repeated rows are rows of one group, each with its own slot.
    Where there are fewer groups than shards the last shards stay empty; no rows give no rows.
    Other columns of ``docs`` are not read.  A group of a third of all rows fills one shard
    beyond the mean, as it must; ranking and summing spread its rows by id.
    """
    need(docs, id_column, text_column)
    text = text_or_empty(text_column)
    sized = stage(
        docs.select(
            F.col(id_column).alias("id"),
            (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("k"),
        ),
        "sharding-sizes",
    )
    _, cuts = minimax_cuts(sized, shards)
    shard = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("k"))) if cuts else F.lit(0)
    dealt = gapless_rank(sized.withColumn("shard", shard.cast("int")), ["shard"], ["id", "k"], shards, sized.count(), "slot")
    return dealt.select(F.col("id").alias(id_column), "size", "text_crc32", "shard", "slot")


def op4_minimax_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``bytes``."""
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
