"""The multigrid preconditioner: its parts, and rounds that do not grow with the raster."""

import numpy as np
import pytest
from test_direct import laplacian

from landgraph.operators import multigrid as M
from landgraph.operators import solve as S
from landgraph.operators.tiles import Tiling


def solved(spark, monkeypatch, n, **how):
    """The relative residual, and the rounds."""
    rounds: list[str] = []
    plain = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name: (rounds.append(name), plain(df, name))[1])
    rows = laplacian(n, n, 7)
    b = spark.createDataFrame([(0, 0, 1.0), (n + 3, 0, -0.5)], "id long, rhs long, value double")
    x = np.zeros(n * n)
    for r in S.linear_solve(spark.createDataFrame(rows).repartition(4), b, rtol=1e-8, **how).collect():
        x[r.id] = r.value
    back = np.zeros(n * n)
    np.add.at(back, rows.src, rows.weight * x[rows.dst])
    back[[0, n + 3]] -= [1.0, -0.5]
    monkeypatch.undo()
    return np.linalg.norm(back[:-1]), rounds.count("cg-round")


def test_rounds_hardly_grow(spark, monkeypatch):
    (small, a), (large, b) = (solved(spark, monkeypatch, n, solver="amg") for n in (23, 46))
    assert small < 2e-8 and large < 2e-8 and b <= a + 6
    monkeypatch.undo()


def test_aggregates_are_connected_and_small(spark):
    rows = laplacian(12, 12, 1, ground=False)
    edges = rows[rows.src != rows.dst].groupby(["src", "dst"], as_index=False)["weight"].sum()
    ids = spark.range(146)  # two vertices without edges
    got = {x.id: x.root for x in M.aggregates(spark.createDataFrame(edges), ids).collect()}
    assert len(got) == 146 and got[144] == 144 and got[145] == 145
    near = lambda v: edges.dst[edges.src == v]
    assert all(v == r or any(got[int(u)] == r for u in near(v)) for v, r in got.items() if v < 144)
    assert max(list(got.values()).count(r) for r in set(got.values())) <= 25
    assert all(got[r] == r for r in got.values()) and len(set(got.values())) < 40


def test_a_cycle_is_symmetric_and_definite(spark):
    rows = laplacian(6, 5, 2)
    cycle = M.multigrid(spark.createDataFrame(rows), coarse=10)
    assert cycle.sizes[0] == 29 and cycle.sizes[-1] <= 10
    basis = spark.createDataFrame([(i, i, 1.0) for i in range(29)], "rhs long, id long, r double")
    z = np.zeros((29, 29))
    for x in cycle(basis, 2).collect():
        z[x.id, x.rhs] += x.z
    assert np.allclose(z, z.T) and np.linalg.eigvalsh(z).min() > 0


def test_blocks_and_solver_functions(spark, monkeypatch):
    error, rounds = solved(spark, monkeypatch, 12, solver="cg", tiling=Tiling(4, 12))
    assert error < 2e-8 and rounds > 2
    error, rounds = solved(spark, monkeypatch, 12, solver=lambda m, b: S.dense_solve(m, b))
    assert error < 1e-9 and rounds == 0
    with pytest.raises(RuntimeError):
        solved(spark, monkeypatch, 12, solver="amg", maxiter=1)
    monkeypatch.undo()
