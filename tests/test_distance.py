import math
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgraph.functions import kernels as K
from landgraph.graph import Graph, GridGraph, mean_weight
from landgraph.operators import algebra
from landgraph.operators import borders as B
from landgraph.operators import distance as D
from landgraph.operators import solve as S
from landgraph.operators.distance import EuclideanDistance, LCPDistance, ResistanceDistance, RSPDistance, euclidean_within
from landgraph.operators.store import materialize
from landgraph.raster import Raster
from landgraph.sources.io import read_csv_raster

#: A folder with raster.csv and distances.csv (to the cell 18, 5 at theta 0.01), if there is one.
DATA = Path(os.environ.get("LANDGRAPH_GOLDEN", "/nonexistent"))


def matrix(df, n, missing=np.inf):
    out = np.full((n, n), missing)
    for r in df.collect():
        out[r.src, r.dst] = r.distance
    return out


def grid(spark, n=3, seed=0):
    p = np.random.default_rng(seed).random((n, n)) + 0.1
    return p, GridGraph(Raster.from_array(spark, p.tolist()), mean_weight)


METRICS = [EuclideanDistance(), LCPDistance(), LCPDistance("floyd-warshall"), LCPDistance(kernel=False), ResistanceDistance(), ResistanceDistance(solver="cg"), RSPDistance(0.1)]


@pytest.mark.parametrize("metric", METRICS[:5] + METRICS[6:])
def test_call_forms_agree(spark, metric):
    _, g = grid(spark)
    whole = matrix(metric(g), 9)
    assert np.isfinite(whole).all()
    some = {(r.src, r.dst): r.distance for r in metric(g, [0, 4], [8]).collect()}
    assert set(some) == {(0, 8), (4, 8)} and all(math.isclose(v, whole[k], rel_tol=1e-6) for k, v in some.items())
    nodes = {(r.src, r.dst): r.distance for r in metric(g, nodes=[(0, 1), (2, 2)]).collect()}
    assert set(nodes) == {(1, 1), (1, 8), (8, 1), (8, 8)} and math.isclose(nodes[1, 8], whole[1, 8], rel_tol=1e-6)


def test_call_errors(spark):
    _, g = grid(spark)
    with pytest.raises(ValueError):
        LCPDistance()(g, [0], nodes=[1])
    plain = Graph.from_array(spark, [[0, 1], [1, 0]])
    with pytest.raises(ValueError):
        LCPDistance()(plain, [(0, 0)])
    with pytest.raises(ValueError):
        EuclideanDistance()(plain)
    with pytest.raises(ValueError):
        LCPDistance("other")


def test_euclidean(spark):
    _, g = grid(spark, 4)
    d = matrix(EuclideanDistance()(g), 16)
    i, j = np.divmod(np.arange(16), 4)
    want = np.hypot(i[:, None] - i, j[:, None] - j)
    assert np.allclose(d, want)
    near = {(r.src, r.dst) for r in euclidean_within(g.raster.cells, 2, 4).collect()}
    assert near == {(a, b) for a in range(16) for b in range(16) if want[a, b] < 2}


def test_known_shortest_paths(spark):
    cost = np.array([[0, 3, np.inf, 7], [8, 0, 2, np.inf], [5, np.inf, 0, 1], [2, np.inf, np.inf, 0]])
    w = np.where(np.isfinite(cost) & (cost > 0), 1 / np.where(cost > 0, cost, 1), 0)
    want = [[0, 3, 5, 6], [5, 0, 2, 3], [3, 6, 0, 1], [2, 5, 7, 0]]
    for metric in (LCPDistance(), LCPDistance("floyd-warshall"), LCPDistance(kernel=False)):
        assert np.allclose(matrix(metric(Graph.from_array(spark, w.tolist())), 4), want)
    trip = matrix(LCPDistance("floyd-warshall", diagonal="roundtrip")(Graph.from_array(spark, w.tolist())), 4)
    assert trip[0, 0] == 8 and trip[1, 0] == 5


def test_searches_agree_and_unreachable_is_absent(spark):
    p = np.random.default_rng(3).random((6, 6)) + 0.05
    p[:, 2:4] = 0  # two columns of zeros cut the grid
    g = GridGraph(Raster.from_array(spark, p.tolist()), mean_weight)
    a, b = (matrix(LCPDistance(kernel=k)(g, [0, 9, 35]), 36) for k in (True, False))
    assert np.allclose(a, b) and np.isinf(a[0, 5]) and np.isfinite(a[0, 1])


@pytest.mark.parametrize("tile,part", [(7, 256), (12, 2), (1000, 256)])
def test_search_by_tiles(spark, monkeypatch, tile, part):
    """Paths that leave tiles and come back, one-way edges, several sources to a task."""
    monkeypatch.setattr(B, "SOURCE_PART", part)
    p = np.random.default_rng(8).random((6, 6)) + 0.05
    p[1::2, 1:] = 0.01  # a comb: the cheap ways go around
    p[3, :] = 0
    g = GridGraph(Raster.from_array(spark, p.tolist()), mean_weight)
    sources = [0, 7, 20, 35]
    a, b = (matrix(LCPDistance(kernel=k, tile=tile)(g, sources), 36) for k in (True, False))
    assert np.allclose(a, b)
    near = D.frontier_search(g.edges(), spark.createDataFrame([(s,) for s in sources], "id long"), max_distance=4.0, tile=tile)
    assert np.allclose(matrix(near, 36), np.where(a <= 4.0, a, np.inf))
    ring = Graph(spark.createDataFrame([(i, (i + 1) % 20, 1.0 + i) for i in range(20)], "src long, dst long, weight double"), 20)
    assert np.allclose(matrix(LCPDistance(kernel=False, tile=6)(ring), 20), matrix(LCPDistance()(ring), 20))


@pytest.mark.parametrize("side,sides", [(3, 1024), (5, 3)])
def test_resistance_by_blocks(spark, monkeypatch, side, sides):
    monkeypatch.setattr(S, "SIDES", sides)
    monkeypatch.setattr(D, "BLOCK_SIDE", side)
    _, g = grid(spark, 8)
    nodes = [0, 5, 17, 40, 63]
    a, b = (matrix(ResistanceDistance(**how)(g, nodes=nodes), 64)[np.ix_(nodes, nodes)] for how in ({}, {"solver": "cg"}))
    assert np.allclose(a, b, rtol=1e-5)


@pytest.mark.parametrize("weights", [(1, 1), (1, 10)])
def test_resistance_as_in_a_circuit(spark, weights):
    r = np.random.default_rng(4)
    w = np.zeros((6, 6))
    for a, b in [(0, 1), (1, 2), (3, 4), (4, 5), (0, 3), (1, 4), (2, 5)]:
        w[a, b] = w[b, a] = r.uniform(*weights)
    v = np.linalg.pinv(np.diag(w.sum(1)) - w)
    want = np.diag(v)[:, None] + np.diag(v) - v - v.T
    for metric in (ResistanceDistance(), ResistanceDistance(solver="cg"), ResistanceDistance(disconnected="pinv")):
        assert np.allclose(matrix(metric(Graph.from_array(spark, w.tolist())), 6), want, atol=1e-6)


def test_resistance_between_components_and_direction(spark):
    two = Graph.from_array(spark, [[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 2], [0, 0, 2, 0]])
    for metric in (ResistanceDistance(), ResistanceDistance(solver="cg")):
        d = matrix(metric(two), 4)
        assert d[0, 1] == pytest.approx(1) and d[2, 3] == pytest.approx(0.5) and np.isinf(d[0, 2])
    assert matrix(ResistanceDistance(disconnected="pinv")(two), 4)[0, 2] == pytest.approx(0.375)
    one_way = Graph.from_array(spark, [[0, 1], [0, 0]])
    with pytest.raises(ValueError):
        ResistanceDistance()(one_way)
    assert matrix(ResistanceDistance(symmetrize=True)(one_way), 2)[0, 1] == pytest.approx(2)


def test_rsp_golden_row(spark):
    ones = Raster.from_array(spark, [[1, 1], [1, 1]])
    g = GridGraph(ones)
    d = matrix(RSPDistance(2.0, cost=lambda w: w)(g), 4)
    assert np.allclose(d[0], [0, 1.01848, 1.01848, 2.01848], atol=1e-4)
    walks = matrix(RSPDistance(2.0, cost=lambda w: w, method="walks")(g), 4)
    assert np.allclose(walks, d, atol=1e-8)
    table = g.edges().select("src", "dst", F.lit(1.0).alias("cost"))
    assert np.allclose(matrix(RSPDistance(2.0, cost=table)(g), 4), d)


def walks_in_few_tables(spark, monkeypatch, weights, theta):
    """Sums over walks to 1 and 4 agree with the dense way, and make fewer than 60 tables."""
    tables, n, g = [], len(weights), Graph.from_array(spark, weights.tolist())

    def counted(df, name="round"):
        tables.append(name)
        assert len(tables) < 60
        return materialize(df, name)

    monkeypatch.setattr(D, "materialize", counted)
    got = matrix(RSPDistance(theta, method="walks")(g, targets=[1, 4]), n)
    assert np.allclose(got[:, [1, 4]], matrix(RSPDistance(theta, method="dense")(g, targets=[1, 4]), n)[:, [1, 4]], atol=1e-8)


def test_walks_that_hardly_end_take_few_rounds(spark, monkeypatch):
    """Weights near one, as between nations of large tables: walks of thousands of steps still count."""
    weights = 1 - 0.01 * np.random.default_rng(4).random((6, 6))
    weights[5] = [0, 0, 0, 0, 0.9, 0]
    walks_in_few_tables(spark, monkeypatch, weights, 0.5)


@pytest.mark.parametrize("products", [0, 200])
def test_walks_go_on_where_the_matrix_would_grow(spark, monkeypatch, products):
    monkeypatch.setattr(D, "WALK_PRODUCTS", products)
    i, weights = np.arange(12), np.zeros((12, 12))
    weights[i, (i + 1) % 12], weights[i, i - 1] = 0.4, 0.5
    walks_in_few_tables(spark, monkeypatch, weights, 2.0)


def test_walks_without_end_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(D, "WALK_DOUBLINGS", 3)
    with pytest.raises(ValueError, match="never end"):
        RSPDistance(1.0, method="walks")(Graph.from_array(spark, [[0, 1], [1, 0]]))


def test_rsp_with_negative_costs_is_dense_only(spark):
    g = Graph.from_array(spark, [[0, 1.2, 0], [1.5, 0, 1.2], [0, 1.5, 0]])
    assert RSPDistance(1.0)(g).count() > 0
    with pytest.raises(ValueError):
        RSPDistance(1.0, method="walks")(g).collect()


@pytest.mark.skipif(not DATA.exists(), reason="no golden raster here")
@pytest.mark.parametrize("method", ["dense", "direct"])
def test_rsp_golden_raster(spark, method):
    raster = read_csv_raster(spark, str(DATA / "raster.csv"))
    golden = np.loadtxt(DATA / "distances.csv", delimiter=",")
    target = int(np.ravel_multi_index((18, 5), golden.shape))
    g = GridGraph(Raster(raster.cells.where("value > 0"), *raster.shape))
    labels = algebra.components(g.edges())
    keep = labels.join(labels.where(F.col("id") == target).select("label"), "label", "left_semi")
    found = RSPDistance(0.01, method=method)(Graph(algebra.prune(g.edges(), keep), g.nv), keep, [target])
    got = np.full(golden.size, np.nan)
    for r in found.collect():
        got[r.src] = r.distance
    got = got.reshape(golden.shape)
    assert np.array_equal(np.isnan(got), np.isnan(golden)) and np.nanmax(np.abs(got - golden) / np.maximum(golden, 1e-9)) < 1e-9


def numeric(f, p, h=1e-6):
    out = np.zeros_like(p)
    for at in np.ndindex(p.shape):
        a, b = p.copy(), p.copy()
        a[at] += h
        b[at] -= h
        out[at] = (f(a) - f(b)) / (2 * h)
    return out


def test_adjoints_against_differences():
    p, weight = np.random.default_rng(5).random((5, 5)) * 0.7 + 0.2, np.random.default_rng(6).random((5, 5))
    s = 12
    lcp = lambda x: float((weight * K.window_lcp(x[None], 2, 2)[0]).sum())
    assert np.allclose(K.window_lcp_adjoint(p[None], K.window_lcp(p[None], 2, 2), weight[None])[0], numeric(lcp, p), rtol=1e-5, atol=1e-6)
    _, v, at = K.window_resistance(p, s)
    assert np.allclose(K.window_resistance_adjoint(p, v, at, weight), numeric(lambda x: float((weight * K.window_resistance(x, s)[0]).sum()), p), rtol=1e-5, atol=1e-6)
    rsp = lambda x: float((weight * K.window_rsp(x, s, 0.1)).sum())
    assert np.allclose(K.window_rsp_adjoint(p, s, 0.1, weight), numeric(rsp, p), rtol=1e-4, atol=1e-5)


def test_window_paths_equal_graph_paths(spark):
    p, g = grid(spark, 5, 8)
    d = matrix(LCPDistance()(g, [12]), 25)[12].reshape(5, 5)
    assert np.allclose(K.window_lcp(p[None], 2, 2)[0], d)
