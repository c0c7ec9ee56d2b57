import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgraph.operators import algebra as A
from landgraph.operators.solve import conjugate_gradient, dense_solve, linear_solve


def frame(spark, m):
    m = np.asarray(m, dtype=float)
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "src long, dst long, weight double")


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.src, r.dst] += r.weight
    return out


@pytest.fixture(scope="module")
def m():
    r = np.random.default_rng(1)
    return np.where(r.random((7, 7)) < 0.6, r.random((7, 7)) - 0.2, 0.0)


def test_entrywise(spark, m):
    e = frame(spark, m)
    assert np.allclose(dense(A.laplacian(e), 7), np.diag(m.sum(1)) - m)
    assert np.allclose(dense(A.map_nonzero(e, lambda w: w * w), 7), np.where(m > 0, m * m, 0))
    for k in (-1, 0, 2):
        assert np.allclose(dense(A.tril(e, k), 7), np.tril(m, k)) and np.allclose(dense(A.triu(e, k), 7), np.triu(m, k))
    assert np.allclose(dense(A.transpose(e), 7), m.T)
    assert np.allclose(dense(A.hadamard(e, A.transpose(e)), 7), m * m.T)
    assert np.allclose(dense(A.canonicalize(e.unionByName(e)), 7), 2 * m)
    positive = np.abs(m)
    want = np.divide(positive, positive.sum(1, keepdims=True), out=np.zeros_like(m), where=positive.sum(1, keepdims=True) > 0)
    assert np.allclose(dense(A.normalize_rows(frame(spark, positive)), 7), want)


def test_set_at(spark, m):
    out = dense(A.set_at(frame(spark, m), spark.createDataFrame([(1, 1, 1.0), (2, 1, 42.0)], "src long, dst long, weight double")), 7)
    want = m.copy()
    want[1, 1], want[2, 1] = 1, 42
    assert np.allclose(out, want)


def test_diagonal_and_vectors(spark, m):
    for values in ([1.0, 2.0, 3.0], [4.0, 5.0], []):
        d = A.diagonal(spark.createDataFrame(list(enumerate(values)), "id long, value double"))
        assert np.allclose(dense(d, len(values)), np.diag(values) if values else np.zeros((0, 0)))
    x = spark.createDataFrame([(i, float(i + 1)) for i in range(7)], "id long, value double")
    got = {r.id: r.value for r in A.spmv(frame(spark, m), x).collect()}
    assert np.allclose([got.get(i, 0.0) for i in range(7)], m @ np.arange(1, 8))
    hot = A.one_hot(spark.createDataFrame([(2,), (9,)], "id long"), 7).collect()
    assert [(r.id, r.rhs, r.value) for r in hot] == [(2, 2, 1.0)]
    ids = spark.createDataFrame([(1,), (3,)], "id long")
    assert np.allclose(dense(A.submatrix(frame(spark, m), ids, ids), 7)[np.ix_([1, 3], [1, 3])], m[np.ix_([1, 3], [1, 3])])


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(120), r.randrange(120), 1.0) for _ in range(90)] + [(i, i + 1, 1.0) for i in range(200, 240)] + [(300, 301, 0.0), (5, 5, 2.0)]
    root = list(range(400))
    for _ in range(60):
        for a, b, w in edges:
            if w:
                root[a] = root[b] = min(root[a], root[b])
    got = {x.id: x.label for x in A.components(spark.createDataFrame(edges, "src long, dst long, weight double"), spark.range(302).select("id")).collect()}
    assert got == {i: root[i] for i in range(302)}


def test_two_components_and_the_largest(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (2, 3, 2.0)], "src long, dst long, weight double")
    labels = A.components(e)
    assert {r.id: r.label for r in labels.collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert A.largest_component(labels).first().label == 0  # of equal ones the least
    keep = labels.where("label = 2")
    assert A.prune(e, keep).count() == 1
    assert [tuple(r)[:2] for r in A.reindex(e, keep)[0].collect()] == [(0, 1)]


def poisson(n):
    line = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    return np.kron(line, np.eye(n)) + np.kron(np.eye(n), line)


def test_solvers(spark):
    m = poisson(5)
    rhs = spark.createDataFrame([(i, k, float(k)) for i in range(25) for k in (1, 2, 3)], "id long, rhs long, value double")
    for solver in (conjugate_gradient, dense_solve):
        x = np.zeros((25, 4))
        for r in solver(frame(spark, m), rhs).collect():
            x[r.id, r.rhs] = r.value
        for k in (1, 2, 3):
            assert np.linalg.norm(m @ x[:, k] - k) < 1e-4
    one = {r.id: r.value for r in linear_solve(frame(spark, m), rhs.where("rhs = 1").drop("rhs")).collect()}
    assert np.allclose(m @ [one[i] for i in range(25)], 1)


def test_solver_errors(spark):
    m, b = frame(spark, poisson(3)), spark.createDataFrame([(0, 0, 1.0)], "id long, rhs long, value double")
    with pytest.raises(RuntimeError):
        conjugate_gradient(m, b, maxiter=1)
    with pytest.raises(ValueError):
        conjugate_gradient(m, b, rtol=-1.0)
    with pytest.raises(ValueError):
        linear_solve(m, b, solver="other")
    assert A.degree(m).where(F.col("degree") < 0).count() == 0
