"""All pairs by blocks against the dense recurrence."""

import numpy as np
import pandas as pd
import pytest

from landgraph.functions import kernels as K
from landgraph.operators import allpairs as A


@pytest.mark.parametrize("block,roundtrip", [(7, False), (7, True), (64, False)])
def test_against_dense(spark, block, roundtrip):
    r = np.random.default_rng(block)
    w = np.where(r.random((31, 31)) < 0.12, r.random((31, 31)) + 0.1, 0.0)
    w[5] = 0.0  # no way out
    src, dst = np.nonzero(w)
    edges = spark.createDataFrame(pd.DataFrame({"src": src, "dst": dst, "weight": w[src, dst]}))
    got = np.full(w.shape, np.inf)
    for x in A.pairs(A.all_pairs(edges, 31, roundtrip, block), 31).collect():
        got[x.src, x.dst] = x.distance
    want = K.floyd_warshall(w, roundtrip)
    assert np.array_equal(np.isfinite(got), np.isfinite(want)) and np.allclose(got[np.isfinite(got)], want[np.isfinite(want)])


def test_kernels():
    r = np.random.default_rng(1)
    a, b, d = (np.where(r.random((9, 9)) < 0.5, r.random((9, 9)), np.inf) for _ in range(3))
    want = np.minimum(d, (a[:, :, None] + b[None]).min(axis=1))
    assert np.array_equal(A.through(d.copy(), a, b), want)
    assert np.array_equal(A.closed(np.full((3, 3), np.inf)), np.full((3, 3), np.inf))


def test_no_edges(spark):
    edges = spark.createDataFrame([], "src long, dst long, weight double")
    got = A.pairs(A.all_pairs(edges, 5, block=2), 5).collect()
    assert sorted(map(tuple, got)) == [(i, i, 0.0) for i in range(5)]
