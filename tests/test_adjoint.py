"""Gradients over whole graphs against differences."""

import numpy as np
import pytest
from test_borders import frame, grid

from landgraph.functions import kernels as K
from landgraph.graph import Graph
from landgraph.operators.adjoint import path_sum_gradient
from landgraph.operators.distance import LCPDistance


@pytest.mark.parametrize("some", [False, True])
def test_path_sums(spark, some):
    edges = grid(5, 4, 3)
    sources = [0, 7, 19]
    share = {(s, t): 1.0 for s in sources for t in range(20)}
    if some:
        share = {(0, 19): 2.0, (7, 3): 0.5, (7, 19): 1.0, (19, 19): 4.0}

    def objective(w):
        paths = K.Paths(edges[0], edges[1], w, 20)
        d = {s: paths.distances(s) for s in sources}
        return sum(x * d[s][t] for (s, t), x in share.items())

    want, h = {}, 1e-6
    for k in range(len(edges[2])):
        a, b = edges[2].copy(), edges[2].copy()
        a[k] += h
        b[k] -= h
        want[edges[0][k], edges[1][k]] = (objective(a) - objective(b)) / (2 * h)
    table = frame(spark, edges)
    pairs = spark.createDataFrame([(s, t, x) for (s, t), x in share.items()], "src long, dst long, share double") if some else None
    found = path_sum_gradient(table, LCPDistance()(Graph(table, 20), sources), pairs)
    got = {(x.src, x.dst): x.gradient for x in found.collect()}
    assert got.keys() <= want.keys() and all(abs(want[k] - got.get(k, 0.0)) < 1e-4 for k in want)
