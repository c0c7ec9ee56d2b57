import random
import zlib

import pytest
from pyspark.sql import functions as F

from landgraph.llm.sharding import minimax_cuts, shard_by_bytes

SCHEMA = "doc_id long, text string, shard string"


def brute(sizes, shards):
    """Smallest capacity for contiguous runs of ``sizes``, by trying each possible sum."""
    def fits(cap):
        runs, at = 1, 0
        for s in sizes:
            if s > cap:
                return False
            if at + s > cap:
                runs, at = runs + 1, 0
            at += s
        return runs <= shards

    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed,n,shards", [(1, 40, 3), (2, 300, 24), (3, 5, 24), (4, 200, 7)])
def test_capacity_is_the_smallest(spark, seed, n, shards):
    r = random.Random(seed)
    groups = {r.randrange(-(2**63), 2**63) if seed != 4 else r.randrange(0, 500): r.choice([1, 3, 9, 40, 400]) for _ in range(n)}
    rows = [(k, s - s // 2) for k, s in groups.items()] + [(k, s // 2) for k, s in groups.items() if s // 2]
    cap, cuts = minimax_cuts(spark.createDataFrame(rows, "k long, size long"), shards)
    assert cap == brute([groups[k] for k in sorted(groups)], shards)
    assert len(cuts) < shards and cuts == sorted(cuts)
    loads = [sum(s for k, s in groups.items() if sum(c <= k for c in cuts) == i) for i in range(shards)]
    assert max(loads) == cap


def test_rows_groups_and_slots(spark):
    r = random.Random(5)
    rows = [(i, "x" * r.randrange(400) if i % 3 else "hot copy", "clash") for i in range(600)]
    rows += [(600, None, None), (601, "", "a"), (602, "é" * 50_000, "b"), (602, "é" * 50_000, "b"), (None, "nobody", None)]
    got = shard_by_bytes(spark.createDataFrame(rows, SCHEMA), 24).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(x[0]) for x in rows)
    texts, where = {x[0]: x[1] or "" for x in rows}, {}
    for x in got:
        raw = texts[x.doc_id].encode()
        assert (x.size, x.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        where.setdefault(texts[x.doc_id], set()).add(x.shard)
    assert all(len(s) == 1 for s in where.values())
    for s in range(24):
        slots = sorted(x.slot for x in got if x.shard == s)
        assert slots == list(range(len(slots)))


def test_empty_and_missing(spark):
    assert shard_by_bytes(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        shard_by_bytes(spark.range(3).withColumn("x", F.lit(1)))
