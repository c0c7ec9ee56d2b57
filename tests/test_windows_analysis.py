import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgraph.functions import kernels as K
from landgraph.functions.proximity import Custom, Exponential, Power, Threshold, TruncatedExponential
from landgraph.operators import landmarks as N
from landgraph.operators import windows as V
from landgraph.operators.analysis import ConnectivityAnalysis, SensitivityAnalysis
from landgraph.operators.distance import EuclideanDistance, LCPDistance, ResistanceDistance, RSPDistance
from landgraph.raster import Raster


def array(df, shape, column="value", row="row", col="col", fill=np.nan):
    out = np.full(shape, fill)
    for r in df.collect():
        out[r[row], r[col]] = np.nan if r[column] is None else r[column]
    return out


def raster(spark, a):
    return Raster.from_array(spark, np.asarray(a, dtype=float).tolist())


def test_one_window_with_nan(spark):
    a = np.arange(1.0, 17).reshape(4, 4)
    a[1, 2] = np.nan
    spec = V.WindowSpec((4, 4), 2, 1)
    assert spec.nb_steps == 1 and spec.total == 4
    core = array(spec.one(raster(spark, a).cells, 0, core=True), (2, 2), row="local_row", col="local_col")
    assert np.array_equal(core, [[6, np.nan], [10, 11]], equal_nan=True)
    whole = array(spec.one(raster(spark, a).cells, 0), (4, 4), row="local_row", col="local_col")
    assert np.array_equal(whole, a, equal_nan=True)


def test_bad_windows():
    for shape, window, buffer in [((5, 4), 2, 1), ((2, 2), 2, 1), ((4, 4), 0, 1)]:
        with pytest.raises(ValueError):
            V.WindowSpec(shape, window, buffer)
    with pytest.raises(TypeError):
        V.WindowSpec((4, 4), 2.0, 1)
    with pytest.raises(ValueError):
        V.WindowSpec((4, 4), 2, 1).origin(1)


@pytest.mark.parametrize("window,buffer,steps", [(3, 2, (2, 3)), (2, 1, (4, 4)), (1, 2, (3, 2)), (4, 0, (2, 2))])
def test_windows_cover_what_slices_do(spark, window, buffer, steps):
    shape = tuple(n * window + 2 * buffer for n in steps)
    a, spec = np.random.default_rng(0).random(shape), V.WindowSpec(shape, window, buffer)
    cells = raster(spark, a).cells
    want = [((x, y), a[x : x + spec.total, y : y + spec.total]) for x in range(0, steps[0] * window, window) for y in range(0, steps[1] * window, window)]
    got = {}
    for r in spec.total_cells(cells).collect():
        got.setdefault(r.window_id, np.full((spec.total,) * 2, np.nan))[r.local_row, r.local_col] = r.value
    assert len(got) == spec.nb_steps and all(np.array_equal(got[k], w) for k, (_, w) in enumerate(want))
    lazy = list(spec.iterate(raster(spark, a)))
    assert [xy for xy, _ in lazy] == [xy for xy, _ in want] and all(np.array_equal(x, w) for (_, x), (_, w) in zip(lazy, want, strict=True))
    assert [(r.x0, r.y0) for r in spec.table(spark).orderBy("window_id").collect()] == [xy for xy, _ in want]
    core = spec.core_cells(cells)
    assert core.count() == steps[0] * steps[1] * window**2 == core.select("row", "col").distinct().count()


def test_merges(spark):
    shape = (8, 8)
    a, spec = np.random.default_rng(1).random(shape), V.WindowSpec((8, 8), 2, 1)
    r = raster(spark, a)
    assert np.array_equal(array(V.merge_cores(r, spec.core_cells(r.cells)).cells, shape), a)
    twice = array(V.merge_cores(r, spec.core_cells(r.cells), V.add).cells, shape)
    want = a.copy()
    want[1:-1, 1:-1] *= 2
    assert np.allclose(twice, want)
    ones = spec.total_cells(r.cells).withColumn("value", F.lit(1.0))
    count = np.zeros(shape)
    last = np.zeros(shape)
    for k, (x, y) in enumerate((x, y) for x in range(0, 6, 2) for y in range(0, 6, 2)):
        count[x : x + 4, y : y + 4] += 1
        last[x : x + 4, y : y + 4] = k
    assert np.allclose(array(V.merge_windows(r, ones, "add").cells, shape), a + count)
    numbered = spec.total_cells(r.cells).withColumn("value", F.col("window_id").cast("double"))
    assert np.allclose(array(V.merge_windows(r, numbered).cells, shape), last)
    assert np.allclose(array(V.merge_windows(r, numbered, lambda cur, new: new).cells, shape), last)


def test_landmarks(spark):
    a = np.arange(1.0, 10).reshape(3, 3)
    at = spark.createDataFrame([(1, 1), (0, 0)], "row int, col int")
    got = {(r.row, r.col): r.value for r in N.sum_neighborhood(raster(spark, a), at, 1).collect()}
    assert got == {(1, 1): 45, (0, 0): 12}
    a[2, 2] = np.nan
    assert N.sum_neighborhood(raster(spark, a), at.limit(1), 3).first().value == 36
    coarse = N.coarse_grain(raster(spark, np.ones((20, 20))), 2)
    assert {(r.row, r.col): r.value for r in coarse.cells.collect()}[2, 2] == 1 and coarse.cells.count() == 16
    with pytest.raises(ValueError):
        N.coarse_grain(raster(spark, np.ones((4, 5))), 1)


def test_proximities_and_derivatives(spark):
    d = np.array([0.5, 1.0, 2.5])
    for p in (Exponential(2.0), Threshold(1.5), Power(2.0), TruncatedExponential(2.0, 1.7)):
        frame = spark.createDataFrame([(float(x),) for x in d], "d double")
        assert np.allclose([r[0] for r in frame.select(p.column(F.col("d")).alias("k")).collect()], p.value(d))
        assert np.allclose(p.derivative(d), (p.value(d + 1e-6) - p.value(d - 1e-6)) / 2e-6, atol=1e-5)
    assert np.allclose(Custom(lambda x: np.exp(-x)).derivative(d), -np.exp(-d), atol=1e-6)


def direct(q, p, metric, proximity, core=1, buffer=2, steps=None, weighted=True):
    """The windows' sum, cut by hand."""
    total, c = core + 2 * buffer, 0.0
    for x in range(0, q.shape[0] - total + 1, core):
        for y in range(0, q.shape[1] - total + 1, core):
            qs, ps = q[x : x + total, y : y + total], p[x : x + total, y : y + total]
            if metric == "lcp":
                d = K.Paths(*_edges(ps), total**2).distances((total // 2) * total + total // 2).reshape(total, total)
            else:
                d = np.hypot(np.arange(total)[:, None] - total // 2, np.arange(total) - total // 2)
            k = np.where(np.isfinite(d), proximity.value(np.where(np.isfinite(d), d, 1)), 0.0)
            k[buffer : buffer + core, buffer : buffer + core] = 0
            c += qs[buffer : buffer + core, buffer : buffer + core].sum() * (k * qs).sum() if weighted else k.sum()
    return c


def _edges(p):
    w = K.grid_weights(p)
    src, dst = np.nonzero(w)
    return src, dst, w[src, dst]


@pytest.mark.parametrize("metric,name", [(LCPDistance(), "lcp"), (EuclideanDistance(), "euclid")])
@pytest.mark.parametrize("weighted", [True, False])
def test_tiled_connectivity_equals_direct(spark, metric, name, weighted):
    r = np.random.default_rng(2)
    q, p = np.pad(r.random((9, 9)), 2), np.pad(r.random((9, 9)), 2)
    proximity = TruncatedExponential(2.0, 4.0)
    run = ConnectivityAnalysis(raster(spark, q), raster(spark, p), metric, proximity, 2, 4)
    padded = [np.pad(x, ((0, run.shape[0] - 13), (0, run.shape[1] - 13))) for x in (q, p)]
    assert run.run(weighted).first().connectivity == pytest.approx(direct(*padded, name, proximity, weighted=weighted), rel=1e-9)


def test_coarse_core_and_function_of_quality(spark):
    q = np.random.default_rng(3).random((17, 17))
    run = ConnectivityAnalysis(raster(spark, q), lambda v: v * 0.5 + 0.1, EuclideanDistance(), Exponential(2.0), 3, 2, coarsening_factor=0.7)
    assert (run.core, run.buffer) == (3, 2)
    padded = np.pad(q, ((0, run.shape[0] - 17), (0, run.shape[1] - 17)))
    assert run.run().first().connectivity == pytest.approx(direct(padded, padded, "euclid", Exponential(2.0), 3, 2), rel=1e-9)


@pytest.mark.parametrize("metric", [LCPDistance(), EuclideanDistance(), ResistanceDistance(), RSPDistance(0.1)])
@pytest.mark.parametrize("var", ["quality", "permeability"])
def test_sensitivity_against_differences(spark, metric, var):
    r = np.random.default_rng(4)
    q, p = r.random((7, 7)) + 0.1, r.random((7, 7)) * 0.6 + 0.3
    make = lambda cls, a, b: cls(raster(spark, a), raster(spark, b), metric, Exponential(2.0), 2, 3)
    got = array(make(SensitivityAnalysis, q, p).run(var), (7, 7), "sensitivity")
    for at in [(3, 3), (0, 2), (6, 6)]:
        sides = []
        for h in (1e-5, -1e-5):
            a, b = q.copy(), p.copy()
            (a if var == "quality" else b)[at] += h
            sides.append(make(ConnectivityAnalysis, a, b).run().first().connectivity)
        assert got[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_sensitivity_options(spark):
    q = np.random.default_rng(5).random((8, 8))
    run = SensitivityAnalysis(raster(spark, q), raster(spark, q), EuclideanDistance(), Exponential(2.0), 2, 3)
    assert run.run("quality", q_weighted=False).where("sensitivity <> 0").count() == 0
    with pytest.raises(ValueError):
        run.run("other")
    assert run.run().count() == 64
    for bad in ({"dependency_range": 0}, {"coarsening_factor": 2.0}):
        with pytest.raises(ValueError):
            SensitivityAnalysis(raster(spark, q), raster(spark, q), EuclideanDistance(), Exponential(1.0), **({"dependency_range": 2, "batch_size": 2} | bad))
    with pytest.raises(ValueError):
        SensitivityAnalysis(raster(spark, q), raster(spark, q[:4]), EuclideanDistance(), Exponential(1.0), 2, 2)
    assert math.isfinite(run.run().agg(F.sum("sensitivity")).first()[0])
