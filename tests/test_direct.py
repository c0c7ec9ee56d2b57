"""Nested dissection against dense solves."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landgraph.graph import Graph, GridGraph, mean_weight
from landgraph.operators import direct as N
from landgraph.operators.distance import ResistanceDistance
from landgraph.operators.solve import linear_solve
from landgraph.operators.tiles import Tiling
from landgraph.raster import Raster


def laplacian(height, width, seed, ground=True):
    """The grounded Laplacian of a rook grid with random conductances, as entries."""
    r = np.random.default_rng(seed)
    at = np.arange(height * width).reshape(height, width)
    a = np.concatenate([at[1:].ravel(), at[:, 1:].ravel()])
    b = np.concatenate([at[:-1].ravel(), at[:, :-1].ravel()])
    w = r.random(len(a)) + 0.1
    rows = pd.DataFrame({"src": np.r_[a, b, a, b], "dst": np.r_[b, a, a, b], "weight": np.r_[-w, -w, w, w]})
    last = height * width - 1
    return rows[(rows.src != last) & (rows.dst != last)] if ground else rows


def dense(rows, n):
    out = np.zeros((n, n))
    np.add.at(out, (rows.src, rows.dst), rows.weight)
    return out


def answers(found, n, sides):
    out = np.full((n, len(sides)), np.nan)
    for x in found.collect():
        assert np.isnan(out[x.id, sides.index(x.rhs)])
        out[x.id, sides.index(x.rhs)] = x.value
    return out


@pytest.mark.parametrize("tiling", [Tiling(3, 13), Tiling(2), Tiling(50, 13)])
def test_against_dense(spark, tiling):
    rows = laplacian(11, 13, 1)
    factor = N.factorize(spark.createDataFrame(rows), tiling)
    for sides, seed in (([7, -3], 2), ([1], 3)):  # one factor for both
        b = np.random.default_rng(seed).random((142, len(sides))) * (np.arange(142)[:, None] % 3 == 0)
        rhs = spark.createDataFrame([(int(i), s, float(b[i, k])) for k, s in enumerate(sides) for i in np.flatnonzero(b[:, k])], "id long, rhs long, value double")
        assert np.allclose(answers(factor.solve(rhs), 142, sides), np.linalg.solve(dense(rows, 142), b))


def test_matrices_that_are_not_symmetric_nor_connected(spark, monkeypatch):
    monkeypatch.setattr(N, "SIDES", 1)
    r = np.random.default_rng(5)
    rows = laplacian(6, 6, 4, ground=False)
    rows["weight"] *= np.where(rows.src != rows.dst, r.random(len(rows)), 1.5)
    rows = pd.concat([rows, pd.DataFrame({"src": [36, 37, 36], "dst": [36, 37, 37], "weight": [2.0, 4.0, -1.0]})])
    b = np.zeros((38, 3))
    b[[0, 20, 37], [0, 1, 2]] = 1
    rhs = spark.createDataFrame([(0, 0, 1.0), (20, 1, 1.0), (37, 2, 1.0)], "id long, rhs long, value double")
    found = N.factorize(spark.createDataFrame(rows), Tiling(2, 6), definite=False).solve(rhs)
    assert np.allclose(answers(found, 38, [0, 1, 2]), np.linalg.solve(dense(rows, 38), b))


def test_errors_and_nothing_to_solve(spark, monkeypatch):
    m = lambda *rows: spark.createDataFrame(list(rows), "src long, dst long, weight double")
    with pytest.raises(Exception, match="not positive definite"):
        N.factorize(m((0, 0, 1.0), (1, 1, 1.0), (0, 1, 2.0), (1, 0, 2.0)))
    with pytest.raises(Exception, match="singular"):
        N.factorize(m((0, 0, 1.0), (1, 1, 1.0), (0, 1, 1.0), (1, 0, 1.0)), definite=False)
    with pytest.raises(Exception, match="front of 4"):
        monkeypatch.setattr(N, "FRONT", 3)
        N.factorize(m(*((i, j, 2.0 if i == j else 0.1) for i in range(4) for j in range(4))))
    assert linear_solve(m().limit(0), spark.createDataFrame([], "id long, value double"), "direct").count() == 0
    one = linear_solve(m((3, 3, 2.0), (3, 3, 2.0)), spark.createDataFrame([(3, 1.0)], "id long, value double"), "direct")
    assert [tuple(x) for x in one.collect()] == [(3, 0.25)]


def test_forty_thousand_unknowns(spark):
    n = 200
    rows = laplacian(n, n, 6)
    factor = N.factorize(spark.createDataFrame(rows).repartition(8), Tiling(8, n))
    sizes = [f.agg(F.max(F.size("own") + F.size("rim"))).first()[0] for f in factor.fronts]
    assert max(sizes) < 4 * n and sum(f.agg(F.sum(F.size("own"))).first()[0] for f in factor.fronts) == n * n - 1
    x = np.zeros(n * n)
    for row in factor.solve(spark.createDataFrame([(0, 0, 1.0)], "id long, rhs long, value double")).toLocalIterator():
        x[row.id] = row.value
    back = np.zeros(n * n)
    np.add.at(back, rows.src, rows.weight * x[rows.dst])
    assert abs(back[0] - 1) < 1e-9 and np.abs(back[1:-1]).max() < 1e-9


def test_resistance(spark):
    cells = spark.range(9 * 7).selectExpr("cast(id div 7 as int) as row", "cast(id % 7 as int) as col", "if(id % 7 = 3, 0.0, 0.2 + (id * 37 % 101) / 100.0) as value")
    graph = GridGraph(Raster.of(cells, 9, 7), mean_weight, barrier=True)  # two components
    found = {how: {(x.src, x.dst): x.distance for x in ResistanceDistance(solver=how)(graph, [0, 30, 62], [2, 34, 62]).collect()} for how in (None, "direct")}
    assert found[None].keys() == found["direct"].keys() and len(found[None]) < 9
    assert all(abs(found[None][k] - found["direct"][k]) < 1e-9 for k in found[None])
    line = Graph(spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(i + 1, i, 1.0) for i in range(40)], "src long, dst long, weight double"), 41)
    assert [round(x.distance, 9) for x in ResistanceDistance(solver="direct")(line, [0], [40, 7]).orderBy("dst").collect()] == [7.0, 40.0]
    with pytest.raises(ValueError):
        ResistanceDistance(solver="lu")(line, [0], [1])
