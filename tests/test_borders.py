"""Search over tile borders against the search by heap."""

import numpy as np
import pytest

from landgraph.functions import kernels as K
from landgraph.operators import borders as B
from landgraph.operators.distance import LCPDistance
from landgraph.operators.tiles import Tiling


def grid(height, width, seed, walls=0.0):
    """(src, dst, weight) of a rook grid with mean weights; some cells are missing."""
    r = np.random.default_rng(seed)
    p = np.where(r.random((height, width)) < walls, 0.0, r.random((height, width)) + 0.05)
    at = np.arange(height * width).reshape(height, width)
    rows = []
    for a, b in ((at[1:], at[:-1]), (at[:-1], at[1:]), (at[:, 1:], at[:, :-1]), (at[:, :-1], at[:, 1:])):
        x, y = p.ravel()[a.ravel()], p.ravel()[b.ravel()]
        keep = (x > 0) & (y > 0)
        rows.append(np.c_[a.ravel()[keep], b.ravel()[keep], ((x + y) / 2)[keep]])
    e = np.concatenate(rows)
    return e[:, 0].astype(int), e[:, 1].astype(int), e[:, 2]


def frame(spark, edges):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(dict(zip(("src", "dst", "weight"), edges, strict=True))))


def ids(spark, given):
    return spark.createDataFrame([(int(i),) for i in given], "id long")


def check(found, edges, n, sources, limit=np.inf, targets=None):
    paths = K.Paths(*edges, n)
    got = {(x.src, x.dst): x.distance for x in found.collect()}
    want = {(s, t): d for s in sources for t, d in enumerate(paths.distances(s)) if np.isfinite(d) and d <= limit and (targets is None or t in targets)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_relax():
    edges = grid(12, 9, 1, 0.2)
    paths = K.Paths(*edges, 108)
    known = np.full((108, 4), np.inf)
    known[[5, 60, 99, 107], np.arange(4)] = [0.0, 1.5, 0.0, 2.0]
    out = B.relax(known.copy(), edges[0], edges[1], 1 / edges[2])
    for k, (s, d) in enumerate(((5, 0.0), (60, 1.5), (99, 0.0), (107, 2.0))):
        assert np.allclose(out[:, k], paths.distances(s) + d)
    assert np.array_equal(B.relax(known.copy(), *(np.array([], dtype=int),) * 2, np.array([])), known)


@pytest.mark.parametrize("side,width", [(7, 31), (100, 31), (5, None)])
def test_tiles_of_any_kind(spark, side, width):
    edges = grid(26, 31, 2, 0.15)
    sources = [0, 17, 400, 805]
    found = B.border_search(frame(spark, edges), ids(spark, [*sources, 17]), Tiling(side, width))
    check(found, edges, 806, sources)


def test_targets_limits_and_sources_without_edges(spark):
    edges = grid(20, 20, 3)
    table = frame(spark, edges)
    check(B.border_search(table, ids(spark, [0, 399]), Tiling(6, 20), ids(spark, [3, 210, 210, 398])), edges, 400, [0, 399], targets={3, 210, 398})
    check(B.border_search(table, ids(spark, [190]), Tiling(6, 20), max_distance=6.5), edges, 400, [190], 6.5)
    one = B.border_search(table, ids(spark, [5000]), Tiling(6, 20)).collect()
    assert [tuple(x) for x in one] == [(5000, 5000, 0.0)]
    assert B.border_search(table, ids(spark, []), Tiling(6, 20)).count() == 0
    assert B.border_search(table.limit(0), ids(spark, [1]), Tiling(6, 20)).count() == 1
    with pytest.raises(RuntimeError):
        B.border_search(table, ids(spark, [0]), Tiling(6, 20), max_rounds=2).count()


def test_directed_edges_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(B, "SOURCE_PART", 3)
    monkeypatch.setattr(B, "LOGS", 2)
    r = np.random.default_rng(4)
    edges = (r.integers(0, 120, 500), r.integers(0, 120, 500), r.random(500) + 0.1)
    _, first = np.unique(edges[0] * 120 + edges[1], return_index=True)
    edges = tuple(x[first] for x in edges)
    check(B.border_search(frame(spark, edges), ids(spark, range(0, 120, 11)), Tiling(4)), edges, 120, list(range(0, 120, 11)))


def test_rounds_grow_with_the_tiles_crossed(spark, monkeypatch):
    rounds = []
    plain = B.materialize_at
    monkeypatch.setattr(B, "materialize_at", lambda df, name: (rounds.append(name), plain(df, name))[1])
    edges = grid(300, 300, 5)
    found = B.border_search(frame(spark, edges), ids(spark, [0]), Tiling(50, 300), ids(spark, [89_999, 45_150]))
    paths = K.Paths(*edges, 90_000).distances(0)
    assert {x.dst: round(x.distance, 6) for x in found.collect()} == {t: round(paths[t], 6) for t in (89_999, 45_150)}
    crossed = 6 + 6 - 1  # from corner to corner
    assert crossed <= rounds.count("border-round") <= 2 * crossed


def test_as_metric_of_a_raster(spark):
    from landgraph.graph import GridGraph, mean_weight
    from landgraph.raster import Raster

    cells = spark.range(15 * 11).selectExpr("cast(id div 11 as int) as row", "cast(id % 11 as int) as col", "0.1 + (id * 37 % 101) / 100.0 as value")
    graph = GridGraph(Raster.of(cells, 15, 11), mean_weight)
    a = {(x.src, x.dst): x.distance for x in LCPDistance(kernel=False, tile=16)(graph, [(0, 0), (14, 10)], [(7, 5), (0, 10)]).collect()}
    b = {(x.src, x.dst): x.distance for x in LCPDistance()(graph, [(0, 0), (14, 10)], [(7, 5), (0, 10)]).collect()}
    assert a.keys() == b.keys() and len(a) == 4 and all(abs(a[k] - b[k]) < 1e-9 for k in a)
