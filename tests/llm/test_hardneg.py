import random
from math import isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgraph.llm import hardneg as H

SCHEMA = "vec_id long, label int, embedding array<double>, rank string, rid long"


def by_hand(rows, positives=5, negatives=5):
    ok = [(i, y, v, k) for k, (i, y, v) in enumerate(rows) if i is not None and y is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, y, v, k in ok:
        if i % 10:
            continue
        others = sorted((-dot(v, w), j, z) for j, z, w, m in ok if m != k)
        for s, p, _ in [x for x in others if x[2] == y][:positives]:
            fits = [x for x in others if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(i, p, r + 1, j, float(-s), float(-t)) for r, (t, j, _) in enumerate(fits)]
    return sorted(out)


def got(spark, rows, **kw):
    frame = spark.createDataFrame([(i, y, v, "clash", 1) for i, y, v in rows], SCHEMA).repartition(3)
    out = H.hard_negatives(frame, F.col("vec_id") % 10 == 0, **kw)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def clusters(seed, n, width=6, spread=12, middle=80):
    r = random.Random(seed)
    mids = [[r.randrange(-middle, middle) for _ in range(width)] for _ in range(7)]
    return [(i, r.randrange(3), [float(x + r.randrange(-spread, spread)) for x in r.choice(mids)]) for i in range(n)]


@pytest.mark.parametrize("seed,steps,part,block", [(1, (4, 20), 2 << 20, 8192), (2, (1, 2), 60, 7)])
def test_against_brute_force(spark, monkeypatch, seed, steps, part, block):
    monkeypatch.setattr(H, "STEPS", steps)
    monkeypatch.setattr(H, "PART", part)
    monkeypatch.setattr(H, "BLOCK", block)
    rows = clusters(seed, 900)
    rows += [(1000 + i, i % 3, [50.0, 50.0, 0.0, 0.0, 0.0, 1.0]) for i in range(200)]  # one vector many times: ties go by id
    rows += [(2000, None, [1.0] * 6), (2010, 1, None), (2020, 1, [1.0, None]), (2030, 1, [float("nan")]), (2040, 2, [float("inf")] * 6), (None, 1, [2.0] * 6)]
    rows += [(2050, 0, []), (2060, 1, [90.0, 3.0]), (2070, 5, [1.0] * 6), (20, 1, [3.0] * 6), (20, 1, [3.0] * 6), (-10, 2, [-9.0] * 6)]
    assert got(spark, rows) == by_hand(rows)


def test_no_rows_no_anchors_and_few_rows(spark):
    assert got(spark, []) == [] and got(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    rows = [(10, 1, [4.0]), (1, 1, [5.0]), (2, 2, [5.0]), (3, 2, [4.0]), (4, 3, [3.0])]
    assert got(spark, rows) == by_hand(rows) == [(10, 1, 1, 2, 20.0, 20.0), (10, 1, 2, 3, 20.0, 16.0)]
    assert got(spark, rows, negatives=1) == [(10, 1, 1, 2, 20.0, 20.0)]
    with pytest.raises(ValueError):
        H.hard_negatives(spark.range(1), F.lit(True))


def test_bounds_hold_and_visits_stop(spark):
    rows = [(k, i, y, v) for k, (i, y, v) in enumerate(clusters(3, 3000, 12, 3, 200))]
    lists = H.Lists(spark.createDataFrame(rows, "rid long, id long, label long, v array<double>"))
    held = lists.rows.toPandas()
    assert len(held) == 3000 and len(lists.centers) == 46
    x, q = H._matrix(list(held.v)), H._matrix(list(held.v[:40]))
    low, high = lists.bounds(q)
    scores = q @ x.T
    assert (scores <= high[:, held.list]).all() and (scores >= low[:, held.list]).all()
    k = 5
    kth = np.sort(scores, axis=1)[:, -k][:, None]
    no = np.full_like(kth, -np.inf)
    first = H.visits(lists, q, no, -no, no, 0, len(lists.centers))
    later = H.visits(lists, q, no, -no, kth, 0, len(lists.centers))
    assert all(len(a) == len(lists.centers) for a in first) and np.mean([len(a) for a in later]) < 15
    for row, to in zip(scores, later, strict=True):  # all that reach the k-th score, ties too, are in visited lists
        assert set(held.list[row >= np.sort(row)[-k]]) <= set(to.tolist())
    inside = H.visits(lists, q, kth * 0.8, kth, no, 0, len(lists.centers))
    for row, to, t in zip(scores, inside, kth[:, 0], strict=True):
        assert set(held.list[(row >= 0.8 * t) & (row <= t)]) <= set(to.tolist())
    again = [set(H.visits(lists, q, no, -no, kth, a, b)[7].tolist()) for a, b in ((0, 4), (4, 46))]
    assert again[0] | again[1] == set(later[7].tolist()) and not again[0] & again[1]


def test_least_score(spark):
    got = spark.range(0, 500).select(H.least_score(F.col("id").cast("double"), 80, 100).alias("s")).collect()
    assert [x.s for x in got] == [-(-80 * p // 100) for p in range(500)]
    assert spark.range(1).select(H.least_score(F.lit(0.5), 80, 100).alias("s")).first().s == 0.4


def test_query_agrees_with_sql(spark):
    import duckdb

    tables = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tables}/embeddings.parquet'")
    assert sorted(map(tuple, H.op13_hard_negatives(spark, tables).collect())) == sorted(con.execute(H.OP13_SQL).fetchall())
