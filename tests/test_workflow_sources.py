import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from landgraph.operators import workflow as X
from landgraph.operators.windows import WindowSpec
from landgraph.raster import Raster
from landgraph.sources import io
from landgraph.streaming.rescore import changed_tiles, rescore


def raster(spark, a):
    return Raster.from_array(spark, np.asarray(a, dtype=float).tolist())


def test_scaling_masks_and_scenarios(spark):
    r = raster(spark, [[100, np.nan], [50, 0]])
    assert sorted(x.value for x in X.scale_fill(r, 100, 0.001).cells.collect()) == [0.001, 0.001, 0.501, 1.001]
    masked = {(x.row, x.col): x.value for x in X.mask_barriers(r.cells, raster(spark, [[1, 0.1], [0.2, 0.0]])).collect()}
    assert masked[0, 0] == 100 and masked[1, 0] == 50 and masked[0, 1] is None and masked[1, 1] is None
    up = X.update_cells(r, spark.createDataFrame([(0, 0, 7.0)], "row int, col int, value double"))
    assert {(x.row, x.col): x.value for x in up.cells.collect()}[0, 0] == 7
    one = lambda v: spark.createDataFrame([(v,)], "connectivity double")
    assert tuple(X.percent_gain(one(2.0), one(3.0)).first()) == (2.0, 3.0, 50.0)


def test_selections(spark):
    df = spark.createDataFrame([(i, 0, float(i)) for i in range(101)], "row int, col int, value double")
    assert X.above_percentile(df, "value").count() == 6
    a, b = ({r.row for r in X.sample_cells(df, 20, s).collect()} for s in (0, 1))
    assert len(a) == 20 and a != b and a == {r.row for r in X.sample_cells(df.repartition(7), 20, 0).collect()}
    share = X.split_rows(df, ["row"]).where("train").count()
    assert 65 <= share <= 95
    c = sorted(r.clipped for r in X.clipped_log(df, "value").where("clipped is not null").collect())
    logs = np.log(np.arange(1, 101))
    assert c[0] == pytest.approx(np.quantile(logs, 0.1)) and c[-1] == pytest.approx(np.quantile(logs, 0.9))


def test_classes_and_blocks(spark):
    df = spark.createDataFrame([(i, j, "abc"[(i + j) % 3]) for i in range(5) for j in range(5)], "row int, col int, kind string")
    ids = X.class_ids(df, "kind")
    assert {(r.kind, r.class_id) for r in ids.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    means = X.block_mean(X.one_hot_classes(ids), 2, 5, 5, ["class_id"])
    total = means.groupBy("row", "col").agg(F.sum("value").alias("v")).collect()
    assert len(total) == 4 and all(r.v == pytest.approx(1) for r in total)
    sites = spark.createDataFrame([("s", 1.4, 0.5)], "site_id string, x double, y double")
    assert tuple(X.nearest_cell(sites, range(3), range(3)).select("row", "col").first()) == (0, 1)
    assert X.unordered_pairs(spark.range(4)).count() == 6


def test_figures_and_model(spark):
    r = np.random.default_rng(0)
    o, p = r.random(50), r.random(50)
    got = X.fit_figures(spark.createDataFrame([(float(a), float(b)) for a, b in zip(o, p, strict=True)], "observed double, predicted double")).first()
    mse = ((o - p) ** 2).mean()
    assert got.mse == pytest.approx(mse) and got.rmse == pytest.approx(mse**0.5) and got.r2 == pytest.approx(1 - mse / o.var())
    out = X.predict_cells(spark.createDataFrame([(1.0, 2.0), (100.0, 0.0)], "a double, b double"), ["a", "b"], lambda x: x[:, 0] - x[:, 1])
    assert [round(r.predicted, 6) for r in out.orderBy("a").collect()] == [round(float(np.exp(-1)), 6), 1000.0]


def test_fit_finds_the_least_squares():
    a = np.random.default_rng(1).random((20, 4))
    y = a @ [1, -2, 3, 0.5]
    loss = lambda x: (float(((a @ x - y) ** 2).mean()), 2 * a.T @ (a @ x - y) / 20)
    assert np.allclose(X.fit(loss, np.zeros(4), 200, tolerance=1e-14), [1, -2, 3, 0.5], atol=1e-4)


def test_files(spark, tmp_path):
    a = np.round(np.random.default_rng(2).random((4, 3)), 6)
    np.savetxt(tmp_path / "a.csv", a, delimiter=",")
    r = io.read_csv_raster(spark, str(tmp_path / "a.csv"))
    assert r.shape == (4, 3) and all(a[x.row, x.col] == x.value for x in r.cells.collect())
    np.save(tmp_path / "m.npy", a)
    assert {(x.src, x.dst): x.value for x in io.read_npy_matrix(spark, str(tmp_path / "m.npy")).collect()} == {k: v for k, v in np.ndenumerate(a)}
    (tmp_path / "s.csv").write_text("site_id,x,y\nq,1.5,2\n")
    assert tuple(io.read_sites(spark, str(tmp_path / "s.csv")).first()) == ("q", 1.5, 2.0)
    io.write_cells(r, str(tmp_path / "cells"), tile=2)
    assert io.read_cells(spark, str(tmp_path / "cells")).cells.count() == 12
    io.write_json(r.cells.coalesce(1), str(tmp_path / "json"))
    assert json.loads(next((tmp_path / "json").glob("part-*")).read_text().splitlines()[0]).keys() == {"row", "col", "value"}
    io.write_csv(r.cells, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 12


def test_csv_in_splits(spark, tmp_path):
    a = np.round(np.random.default_rng(3).random((300, 17)), 5)
    lines = [",".join(map(str, r)) for r in a]
    lines[7], lines[40] = "", " , NA,," + ",".join(map(str, a[40, 3:]))
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        r = io.read_csv_raster(spark, str(tmp_path / "a.csv"))
        assert r.shape == (300, 17) and io.numbered_lines(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5
        got = np.full((300, 17), -1.0)
        for x in r.cells.collect():
            got[x.row, x.col] = x.value
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    a[7], a[40, :3] = -1.0, np.nan
    assert np.array_equal(got, a, equal_nan=True)
    (tmp_path / "two").mkdir()
    for n in "ab":
        (tmp_path / "two" / f"{n}.csv").write_text("1,2\n")
    with pytest.raises(ValueError):
        io.read_csv_raster(spark, str(tmp_path / "two"))
    (tmp_path / "semi.csv").write_text("1|2\n3|4\n")
    assert io.read_csv_raster(spark, str(tmp_path / "semi.csv"), "|").shape == (2, 2)


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.95, 1.0])
def test_quantiles(spark, share, monkeypatch):
    monkeypatch.setattr(X, "BINS", 4)
    values = [1.0] * 9 + [2.5, -3.0, 1e9, 7.0, 7.0, 8.25, 0.1, 0.2, 0.3] + [None]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = X.quantiles(frame, "x", [share]).collect()
    assert [x.share for x in got] == [share] and got[0].cut == pytest.approx(np.quantile(values[:-1], share), rel=1e-12)
    assert X.quantiles(frame.where("x is null"), "x", [share]).count() == 0


def test_rescoring_stream(spark, tmp_path):
    spec = WindowSpec((8, 8), 3, 1)
    r = raster(spark, np.zeros((8, 8)))
    source = tmp_path / "in"
    score = lambda now, tiles: spec.total_cells(now.cells).join(tiles, "window_id", "left_semi").groupBy("window_id").agg(F.sum("value").alias("score"))
    for n, change in enumerate([[(0, 0, 5.0)], [(0, 0, 7.0), (4, 4, 1.0)]]):
        spark.createDataFrame(change, "row int, col int, value double").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("row int, col int, value double").parquet(str(source))
        q = rescore(stream, r, spec, score, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        q.stop()
    got = {(x.batch, x.window_id): x.score for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, 0): 5.0, (1, 0): 8.0, (1, 1): 1.0, (1, 2): 1.0, (1, 3): 1.0}
    assert changed_tiles(spec, spark.createDataFrame([(0, 7)], "row int, col int")).count() == 1
