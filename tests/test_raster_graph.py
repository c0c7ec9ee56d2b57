import math

import pytest
from pyspark.sql import functions as F

from landgraph.graph import QUEEN, Graph, GridGraph, mean_weight
from landgraph.raster import Raster, coord_to_index, index_to_coord, padded_shape


def table(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def test_indices_and_back(spark):
    df = spark.createDataFrame([(0, 0), (1, 2)], "row int, col int")
    ids = coord_to_index(df, 3)
    assert [r.id for r in ids.orderBy("id").collect()] == [0, 5]
    back = index_to_coord(ids.select("id"), 3).orderBy("id").collect()
    assert [(r.row, r.col) for r in back] == [(0, 0), (1, 2)]


def test_values_to_rows_and_back(spark):
    values = spark.createDataFrame([(i, 10.0 * (i + 1)) for i in range(6)], "id long, value double")
    r = Raster.from_node_values(values, 2, 3)
    assert {x.row: x["values"] for x in r.rows().collect()} == {0: [10, 20, 30], 1: [40, 50, 60]}
    assert table(r.node_values(), "id", "value") == {(i,): 10.0 * (i + 1) for i in range(6)}


def test_unit_grid(spark):
    g = GridGraph(Raster.from_array(spark, [[1] * 3] * 2))
    e = table(g.edges(), "src", "dst", "weight")
    assert len(e) == 14 and set(e.values()) == {1.0} and g.nv == 6 and repr(g) == "GridGraph(2 rows, 3 columns, 4 neighbours)"


def test_target_weight_and_functions(spark):
    g = GridGraph(Raster.from_array(spark, [[1, 1, 5], [1, 1, 1]]))
    e = table(g.edges(), "src", "dst", "weight")
    assert {k for k, w in e.items() if w == 5} == {(1, 2), (5, 2)}
    ones = Raster.from_array(spark, [[1] * 3] * 2)
    assert set(table(GridGraph(ones, lambda x, y: 4 * (x + y)).edges(), "src", "dst", "weight").values()) == {8.0}
    assert GridGraph(ones, neighbors=QUEEN).edges().count() == 14 + 8


def test_barriers(spark):
    r = Raster.from_array(spark, [[1, 0, 1]])
    assert table(GridGraph(r, mean_weight).edges(), "src", "dst", "weight") == {(0, 1): 0.5, (1, 0): 0.5, (1, 2): 0.5, (2, 1): 0.5}
    assert GridGraph(r, mean_weight, barrier=True).edges().count() == 0
    assert GridGraph(r).edges().count() == 2  # a zero target is no edge


def test_gradient_is_the_in_degree(spark):
    g = table(GridGraph(Raster.from_array(spark, [[0.5] * 10] * 10)).edge_sum_gradient(), "id", "gradient")
    for (i,), d in g.items():
        border = (i // 10 in (0, 9)) + (i % 10 in (0, 9))
        assert d == 4 - border
    half = table(GridGraph(Raster.from_array(spark, [[1, 2]]), mean_weight).edge_sum_gradient(lambda x, y: F.lit(0.5), lambda x, y: F.lit(0.5)), "id", "gradient")
    assert half == {(0,): 1.0, (1,): 1.0}


def test_nodata(spark):
    rows = [[1, math.nan], [None, 4]]
    assert Raster.from_array(spark, rows, "barrier").cells.count() == 2
    assert sorted(r.value for r in Raster.from_array(spark, rows, "zero").cells.collect()) == [0, 0, 1, 4]
    with pytest.raises(ValueError):
        Raster.from_array(spark, rows, "other")
    with pytest.raises(ValueError):
        Raster(spark.range(1), 1, 1)


@pytest.mark.parametrize("shape,buffer,window", [((2300, 3600), 50, 3), ((230, 360), 3, 27)])
def test_padding(shape, buffer, window):
    h, w = padded_shape(shape, buffer, window)
    assert (h - 2 * buffer) % window == 0 and (w - 2 * buffer) % window == 0 and 0 <= h - shape[0] < window


def test_pad_fills_below_and_right(spark):
    p = Raster.from_array(spark, [[1, 2, 0], [3, 4, 0], [0, 0, 0]]).pad(1, 3)
    assert p.shape == (5, 5)
    cells = table(p.cells, "row", "col", "value")
    assert len(cells) == 25 and cells[1, 1] == 4 and cells[4, 4] == 0
    b = table(Raster.from_array(spark, [[1]]).pad_border(1).cells, "row", "col", "value")
    assert b[1, 1] == 1 and sum(b.values()) == 1 and len(b) == 9


def test_parallel_edges_add_up(spark):
    g = Graph(spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0), (1, 0, 0.0)], "src long, dst long, weight double"))
    assert table(g.edges(), "src", "dst", "weight") == {(0, 1): 3.0} and g.nv == 2
    assert Graph.from_rows(spark.createDataFrame([(0, [0.0, 2.0])], "src long, weights array<double>"), 2).edges().count() == 1
