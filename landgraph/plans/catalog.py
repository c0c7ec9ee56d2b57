"""Registered queries of the connectivity engine and their DuckDB oracles.

The driver's tables hold no rasters, so some are derived: RAST, 24 x 24 cells from ``lineitem``;
TRADE, the flow of quantity between nations; EVT, users and event types; EMB, the embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.proximity import Exponential, Threshold, TruncatedExponential
from ..graph import QUEEN, Graph, GridGraph, mean_weight
from ..operators import algebra, landmarks, windows, workflow
from ..operators.adjoint import path_sum_gradient
from ..operators.analysis import ConnectivityAnalysis, SensitivityAnalysis
from ..operators.distance import Distance, EuclideanDistance, LCPDistance, ResistanceDistance, RSPDistance, euclidean_within
from ..operators.solve import linear_solve
from ..operators.store import materialize
from ..raster import Raster, coord_to_index, index_to_coord

Query = Callable[[SparkSession, str], DataFrame]
SIDE, NATIONS, DIGITS = 24, 25, 6
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in columns})


# --- derived inputs ---------------------------------------------------------------------------


def rast(spark: SparkSession, d: str, measure: str = "p") -> Raster:
    """Permeability (mean quantity / 50), or quality (mean discount), of 24 x 24 cells."""
    value = F.sum("l_quantity") / F.count(F.lit(1)) / 50 if measure == "p" else F.sum("l_discount") / F.count(F.lit(1))
    cells = spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_orderkey") % SIDE).cast("int").alias("row"), (F.col("l_partkey") % SIDE).cast("int").alias("col"))
    return Raster.of(cells.agg(value.alias("value")), SIDE, SIDE)


def trade(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, weight): quantity from suppliers' to customers' nations, over the largest.  The sums are stored: plans over
    this table read at most a row for each pair of nations, not the tables again."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    sold = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").cast("long").alias("src"), "l_quantity")
    bought = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("long").alias("dst"))
    flow = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("src", "dst").agg(F.sum("l_quantity").alias("weight"))
    flow = materialize(flow, "trade")
    top = flow.agg(F.max("weight").alias("top")).withColumn("k", F.lit(0))
    return flow.withColumn("k", F.lit(0)).join(F.broadcast(top), "k").select("src", "dst", (F.col("weight") / F.col("top")).alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """The mean of both directions, without loops."""
    both = edges.unionByName(algebra.transpose(edges)).where("src <> dst")
    return both.groupBy("src", "dst").agg((F.sum("weight") / 2).alias("weight"))


def emb(spark: SparkSession, d: str) -> Raster:
    """The embeddings as a raster: one row for each vector."""
    cells = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "value"))
    return Raster.of(cells)


RAST = """rast AS (SELECT CAST(l_orderkey % 24 AS INTEGER) AS r, CAST(l_partkey % 24 AS INTEGER) AS c,
  sum(l_quantity) / count(*) / 50 AS p, sum(l_discount) / count(*) AS q FROM lineitem GROUP BY 1, 2)"""
STEP4 = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(i, j)"
EDGES = f"""{RAST}, mean_edges AS (SELECT CAST(a.r * 24 + a.c AS BIGINT) AS src, CAST(b.r * 24 + b.c AS BIGINT) AS dst, (a.p + b.p) / 2 AS weight
  FROM rast a, {STEP4}, rast b WHERE b.r = a.r + o.i AND b.c = a.c + o.j)"""
TRADE = """flow AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, sum(l_quantity) AS w
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
trade AS (SELECT src, dst, w / (SELECT max(w) FROM flow) AS weight FROM flow)"""
BOTH = f"""{TRADE}, both_ways AS (SELECT src, dst, sum(weight) / 2 AS weight FROM
  (SELECT src, dst, weight FROM trade UNION ALL SELECT dst, src, weight FROM trade) WHERE src <> dst GROUP BY 1, 2)"""
EMB = """emb AS (SELECT CAST(vec_id AS INTEGER) AS r, CAST(unnest(generate_series(0, 63)) AS INTEGER) AS c,
  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


# --- rasters and grid graphs (G, M) -----------------------------------------------------------


@query(f'WITH {RAST} SELECT r AS "row", c AS "col", CAST(r * 24 + c AS BIGINT) AS id FROM rast')
def coord_to_index_query(spark, d):
    return coord_to_index(rast(spark, d).cells.select("row", "col"), SIDE)


@query(f"WITH {RAST} SELECT CAST(r * 24 + c AS BIGINT) AS id, r AS \"row\", c AS \"col\" FROM rast")
def index_to_coord_query(spark, d):
    return index_to_coord(rast(spark, d).node_values().select("id"), SIDE)


@query(f"WITH {RAST} SELECT CAST(r * 24 + c AS BIGINT) AS id, round(p, 6) AS value FROM rast")
def array_to_node_values(spark, d):
    return rounded(rast(spark, d).node_values(), "value")


@query(f'WITH {EMB} SELECT r AS "row", round(sum(v * (c + 1)), 4) AS dot, count(*) AS n FROM emb GROUP BY 1')
def node_values_to_array(spark, d):
    r = emb(spark, d)
    rows = Raster.from_node_values(r.node_values(), r.height, r.width).rows()
    dot = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("row", (F.round(dot, 4) + 0.0).alias("dot"), F.size("values").cast("long").alias("n"))


@query(f"WITH {RAST} SELECT max(r) + 1 AS height, max(c) + 1 AS width, CAST((max(r) + 1) * (max(c) + 1) AS BIGINT) AS nv FROM rast")
def grid_shape(spark, d):
    r = Raster.of(rast(spark, d).cells)
    return spark.range(1).select(F.lit(r.height).alias("height"), F.lit(r.width).alias("width"), F.lit(r.nv).cast("long").alias("nv"))


@query(f"""WITH {RAST} SELECT CAST(a.r * 24 + a.c AS BIGINT) AS src, CAST(b.r * 24 + b.c AS BIGINT) AS dst, round(b.p, 6) AS weight
FROM rast a, {STEP4}, rast b WHERE b.r = a.r + o.i AND b.c = a.c + o.j""")
def rook_edges_target(spark, d):
    return rounded(GridGraph(rast(spark, d)).edges(), "weight")


@query(f"WITH {EDGES} SELECT src, dst, round(weight, 6) AS weight FROM mean_edges")
def rook_edges_mean(spark, d):
    return rounded(GridGraph(rast(spark, d), mean_weight).edges(), "weight")


@query(f"""WITH {RAST} SELECT CAST(a.r * 24 + a.c AS BIGINT) AS src, CAST(b.r * 24 + b.c AS BIGINT) AS dst, round(4 * (a.p + b.p), 6) AS weight
FROM rast a, rast b WHERE abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c)""")
def queen_edges_custom(spark, d):
    return rounded(GridGraph(rast(spark, d), lambda x, y: 4 * (x + y), QUEEN).edges(), "weight")


@query(f"""WITH {RAST} SELECT CAST(b.r * 24 + b.c AS BIGINT) AS id, CAST(count(*) AS DOUBLE) AS gradient
FROM rast a, {STEP4}, rast b WHERE b.r = a.r + o.i AND b.c = a.c + o.j GROUP BY 1""")
def edge_gradient(spark, d):
    return GridGraph(rast(spark, d)).edge_sum_gradient()


# --- sparse matrices (A) ----------------------------------------------------------------------


@query(f"WITH {TRADE} SELECT src AS id, round(sum(weight), 6) AS degree FROM trade GROUP BY 1")
def degree(spark, d):
    return rounded(algebra.degree(trade(spark, d)), "degree")


@query(f"""WITH {TRADE} SELECT src, dst, round(sum(weight), 6) AS weight FROM
(SELECT src, dst, -weight AS weight FROM trade UNION ALL SELECT src, src, sum(weight) FROM trade GROUP BY src) GROUP BY 1, 2""")
def laplacian(spark, d):
    return rounded(algebra.laplacian(trade(spark, d)), "weight")


@query(f"WITH {TRADE} SELECT src, dst, round(ln(weight - 0.5), 6) AS weight FROM trade WHERE weight - 0.5 > 0")
def map_nonzero(spark, d):
    return rounded(algebra.map_nonzero(trade(spark, d).withColumn("weight", F.col("weight") - 0.5), F.log), "weight")


@query(f"WITH {TRADE} SELECT src, src AS dst, round(sum(weight), 6) AS weight FROM trade GROUP BY 1")
def diagonal(spark, d):
    return rounded(algebra.diagonal(algebra.degree(trade(spark, d)).withColumnRenamed("degree", "value")), "weight")


@query(f"WITH {TRADE} SELECT src, dst, round(weight, 6) AS weight FROM trade WHERE src >= dst - 1")
def tril(spark, d):
    return rounded(algebra.tril(trade(spark, d), 1), "weight")


@query(f"WITH {TRADE} SELECT src, dst, round(weight, 6) AS weight FROM trade WHERE src <= dst - 1")
def triu(spark, d):
    return rounded(algebra.triu(trade(spark, d), 1), "weight")


@query(f"""WITH {TRADE} SELECT src, dst, round(weight, 6) AS weight FROM trade WHERE src <> dst
UNION ALL SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS DOUBLE) FROM nation""")
def set_at(spark, d):
    new = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"), F.col("n_regionkey").cast("double").alias("weight"))
    flow = trade(spark, d)
    old = flow.where("src <> dst").unionByName(flow.where("src = dst"))
    return rounded(algebra.set_at(old, new), "weight")


@query(f"WITH {TRADE} SELECT src, dst, round(weight * 2, 6) AS weight FROM trade")
def canonicalize(spark, d):
    flow = trade(spark, d)
    return rounded(algebra.canonicalize(flow.unionByName(flow)), "weight")


@query(f"WITH {TRADE} SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS weight FROM trade")
def row_normalize(spark, d):
    return rounded(algebra.normalize_rows(trade(spark, d)), "weight")


@query(f"WITH {TRADE} SELECT a.src, a.dst, round(a.weight * b.weight, 6) AS weight FROM trade a JOIN trade b ON a.src = b.dst AND a.dst = b.src")
def hadamard(spark, d):
    flow = trade(spark, d)
    return rounded(algebra.hadamard(flow, algebra.transpose(flow)), "weight")


@query(f"WITH {TRADE} SELECT dst AS src, src AS dst, round(weight, 6) AS weight FROM trade")
def transpose(spark, d):
    return rounded(algebra.transpose(trade(spark, d)), "weight")


@query(f"""WITH {TRADE} SELECT src, dst, round(weight, 6) AS weight FROM trade
WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def submatrix(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").withColumn("id", F.col("n_nationkey").cast("long"))
    return rounded(algebra.submatrix(trade(spark, d), n.where("n_regionkey = 1"), n.where("n_regionkey = 2")), "weight")


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS rhs, CAST(1.0 AS DOUBLE) AS value FROM nation WHERE n_nationkey < 20")
def one_hot_basis(spark, d):
    return algebra.one_hot(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id")), 20)


@query(f"WITH {TRADE} SELECT src AS id, round(sum(weight * (n_regionkey + 1)), 6) AS value FROM trade JOIN nation ON dst = n_nationkey GROUP BY 1")
def spmv(spark, d):
    v = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1.0).alias("value"))
    return rounded(algebra.spmv(trade(spark, d), v), "value")


_HALF = f"""{RAST}, high AS (SELECT r, c FROM rast WHERE p > (SELECT avg(p) FROM rast)),
link AS (SELECT CAST(a.r * 24 + a.c AS BIGINT) AS src, CAST(b.r * 24 + b.c AS BIGINT) AS dst FROM high a, {STEP4}, high b WHERE b.r = a.r + o.i AND b.c = a.c + o.j),
reach(id, seen) AS (SELECT CAST(r * 24 + c AS BIGINT), CAST(r * 24 + c AS BIGINT) FROM high UNION SELECT reach.id, link.dst FROM reach JOIN link ON reach.seen = link.src),
labels AS (SELECT id, min(seen) AS label FROM reach GROUP BY id)"""


def high_cells(spark, d) -> GridGraph:
    """The graph of the cells above the mean."""
    cells = rast(spark, d).cells
    mean = cells.agg(F.avg("value").alias("mean")).withColumn("k", F.lit(0))
    high = cells.withColumn("k", F.lit(0)).join(F.broadcast(mean), "k").where("value > mean").select("row", "col", "value")
    return GridGraph(Raster(high, SIDE, SIDE), mean_weight)


@query(f"WITH RECURSIVE {_HALF} SELECT id, label FROM labels")
def components(spark, d):
    g = high_cells(spark, d)
    return algebra.components(g.edges(), g.raster.node_values())


@query(f"WITH RECURSIVE {_HALF} SELECT label, count(*) AS n FROM labels GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def largest_component(spark, d):
    return algebra.largest_component(components(spark, d))


@query(f"""WITH RECURSIVE {_HALF}, top AS (SELECT label FROM labels GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT src, dst FROM link WHERE src IN (SELECT id FROM labels WHERE label IN (SELECT label FROM top))""")
def prune_component(spark, d):
    g = high_cells(spark, d)
    labels = algebra.components(g.edges(), g.raster.node_values())
    keep = labels.join(algebra.largest_component(labels), "label", "left_semi")
    return algebra.prune(g.edges(), keep).select("src", "dst")


@query(f"""WITH RECURSIVE {_HALF}, top AS (SELECT label FROM labels GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
keep AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM labels WHERE label IN (SELECT label FROM top))
SELECT a.k AS src, b.k AS dst FROM link JOIN keep a ON src = a.id JOIN keep b ON dst = b.id""")
def reindex_component(spark, d):
    g = high_cells(spark, d)
    labels = algebra.components(g.edges(), g.raster.node_values())
    return algebra.reindex(g.edges(), labels.join(algebra.largest_component(labels), "label", "left_semi"))[0].select("src", "dst")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS src, event_type AS t FROM events WHERE value > 0),
n AS (SELECT src, CAST(100000000 + rank AS BIGINT) AS dst FROM e JOIN (SELECT t, row_number() OVER (ORDER BY t) AS rank FROM (SELECT DISTINCT t FROM e)) USING (t)),
l AS (SELECT src, dst FROM n UNION ALL SELECT dst, src FROM n),
reach(id, seen) AS (SELECT src, src FROM l UNION SELECT reach.id, l.dst FROM reach JOIN l ON reach.seen = l.src)
SELECT id, min(seen) AS label FROM reach GROUP BY 1""")
def components_bipartite(spark, d):
    """Components of the users and event types of events that have a value."""
    e = spark.read.parquet(f"{d}/events.parquet").where("value > 0").select(F.col("user_id").cast("long").alias("src"), "event_type").distinct()
    return algebra.components(workflow.class_ids(e, "event_type").select("src", (100_000_001 + F.col("class_id")).cast("long").alias("dst"), F.lit(1.0).alias("weight")))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS src, event_type AS t FROM events),
n AS (SELECT src, CAST(100000000 + rank AS BIGINT) AS dst FROM e JOIN (SELECT t, row_number() OVER (ORDER BY t) AS rank FROM (SELECT DISTINCT t FROM e)) USING (t)),
l AS (SELECT src, dst FROM n UNION ALL SELECT dst, src FROM n),
reach(id, seen) AS (SELECT src, src FROM l UNION SELECT reach.id, l.dst FROM reach JOIN l ON reach.seen = l.src)
SELECT id, min(seen) AS label FROM reach GROUP BY 1""")
def components_bipartite_whole(spark, d):
    """Components of all users and event types."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("long").alias("src"), "event_type").distinct()
    return algebra.components(workflow.class_ids(e, "event_type").select("src", (100_000_001 + F.col("class_id")).cast("long").alias("dst"), F.lit(1.0).alias("weight")))


# --- distances (D, E, L, R, P) ----------------------------------------------------------------


@query(f"""WITH {RAST}, s AS (SELECT * FROM rast WHERE r = 3), t AS (SELECT * FROM rast WHERE c = 5)
SELECT CAST(s.r * 24 + s.c AS BIGINT) AS src, CAST(t.r * 24 + t.c AS BIGINT) AS dst, round(sqrt(CAST((s.r - t.r) * (s.r - t.r) + (s.c - t.c) * (s.c - t.c) AS DOUBLE)), 6) AS distance FROM s, t""")
def euclid_pairs(spark, d):
    g = GridGraph(rast(spark, d))
    return rounded(EuclideanDistance()(g, g.raster.cells.where("row = 3"), g.raster.cells.where("col = 5")), "distance")


@query(f"""WITH {RAST}, s AS (SELECT * FROM rast WHERE p > (SELECT avg(p) FROM rast))
SELECT CAST(s.r * 24 + s.c AS BIGINT) AS src, CAST(t.r * 24 + t.c AS BIGINT) AS dst, round(sqrt(CAST((s.r - t.r) * (s.r - t.r) + (s.c - t.c) * (s.c - t.c) AS DOUBLE)), 6) AS distance FROM s, s t""")
def euclid_nodes(spark, d):
    """Between the cells of more than the mean permeability, the habitat."""
    g = GridGraph(rast(spark, d))
    mean = g.raster.cells.agg(F.avg("value").alias("mean"))
    return rounded(EuclideanDistance()(g, nodes=g.raster.cells.crossJoin(F.broadcast(mean)).where("value > mean")), "distance")


@query(f"""WITH {RAST} SELECT CAST(s.r * 24 + s.c AS BIGINT) AS src, CAST(t.r * 24 + t.c AS BIGINT) AS dst,
round(sqrt(CAST((s.r - t.r) * (s.r - t.r) + (s.c - t.c) * (s.c - t.c) AS DOUBLE)), 6) AS distance FROM rast s, rast t
WHERE (s.r - t.r) * (s.r - t.r) + (s.c - t.c) * (s.c - t.c) < 9""")
def euclid_within(spark, d):
    return rounded(euclidean_within(rast(spark, d).cells, 3, SIDE), "distance")


def _lcp_sql(sources: str, where: str = "TRUE") -> str:
    return f"""WITH RECURSIVE {EDGES}, best(s, v, d) USING KEY (s, v) AS (
  SELECT CAST(x AS BIGINT), CAST(x AS BIGINT), CAST(0.0 AS DOUBLE) FROM (VALUES {sources}) AS q(x)
  UNION SELECT b.s, e.dst, min(b.d + 1 / e.weight) FROM best b JOIN mean_edges e ON b.v = e.src
    LEFT JOIN recurring.best k ON k.s = b.s AND k.v = e.dst WHERE k.d IS NULL OR b.d + 1 / e.weight < k.d GROUP BY b.s, e.dst)
SELECT s AS src, v AS dst, round(d, 6) AS distance FROM best WHERE {where}"""


def mean_grid(spark, d) -> GridGraph:
    return GridGraph(rast(spark, d), mean_weight)


@query(_lcp_sql("(0)"))
def lcp_single(spark, d):
    return rounded(LCPDistance()(mean_grid(spark, d), [0]), "distance")


@query(_lcp_sql("(0), (100), (575)"))
def lcp_multi(spark, d):
    return rounded(LCPDistance()(mean_grid(spark, d), [0, 100, 575]), "distance")


@query(_lcp_sql("(5), (300)", "v IN (10, 20, 570)"))
def lcp_targets(spark, d):
    return rounded(LCPDistance()(mean_grid(spark, d), [5, 300], [10, 20, 570]), "distance")


@query(_lcp_sql("(27), (250)", "v IN (27, 250)"))
def lcp_coords(spark, d):
    return rounded(LCPDistance()(mean_grid(spark, d), nodes=[(1, 3), (10, 10)]), "distance")


@query(_lcp_sql("(0)"))
def lcp_by_joins(spark, d):
    """The search tile by tile over the whole raster, in tiles of six rows, as ``lcp_single`` does by the kernel."""
    return rounded(LCPDistance(kernel=False, tile=6 * SIDE)(mean_grid(spark, d), [0]), "distance")


@query(_lcp_sql("(0), (100), (575)"))
def lcp_by_joins_whole(spark, d):
    """The same from three sources, in tiles of 100 vertices, which are no whole rows."""
    return rounded(LCPDistance(kernel=False, tile=100)(mean_grid(spark, d), [0, 100, 575]), "distance")


_FW = f"""{TRADE}, fw(k, i, j, d) AS (
  SELECT CAST(-1 AS BIGINT), i, j, CASE WHEN i = j THEN 0.0 ELSE coalesce(1 / weight, CAST('inf' AS DOUBLE)) END FROM range(25) a(i), range(25) b(j) LEFT JOIN trade ON src = i AND dst = j
  UNION ALL SELECT x.k + 1, x.i, x.j, least(x.d, a.d + b.d) FROM fw x JOIN fw a ON a.i = x.i AND a.j = x.k + 1 JOIN fw b ON b.i = x.k + 1 AND b.j = x.j WHERE x.k < 24)"""


@query(f"WITH RECURSIVE {_FW} SELECT i AS src, j AS dst, round(d, 6) AS distance FROM fw WHERE k = 24 AND isfinite(d)")
def lcp_all_pairs(spark, d):
    return rounded(LCPDistance("floyd-warshall")(Graph(trade(spark, d), NATIONS)), "distance")


@query(f"WITH RECURSIVE {_FW} SELECT round(sum(d) / 625, 6) AS average_path_length FROM fw WHERE k = 24 AND isfinite(d)")
def average_path_length(spark, d):
    found = LCPDistance("floyd-warshall")(Graph(trade(spark, d), NATIONS))
    return rounded(workflow.average_path_length(found, NATIONS), "average_path_length")


@query(f"""WITH RECURSIVE {_FW}, used AS (
  SELECT src, dst, weight, (SELECT count(*) FROM fw a, fw b, fw p WHERE a.k = 24 AND b.k = 24 AND p.k = 24 AND a.j = src AND b.i = dst AND p.i = a.i AND p.j = b.j
    AND isfinite(p.d) AND abs(a.d + 1 / weight + b.d - p.d) < 1e-12) AS n FROM trade WHERE src <> dst)
SELECT src, dst, round(-n / (weight * weight) / 625, 6) + 0.0 AS gradient FROM used WHERE n > 0""")
def average_path_length_gradient(spark, d):
    """By the weight of each edge that shortest paths use."""
    graph = Graph(trade(spark, d), NATIONS)
    found = path_sum_gradient(graph.edges(), LCPDistance()(graph))
    return rounded(found.withColumn("gradient", F.col("gradient") / float(NATIONS**2)), "gradient")


def _inverse(table: str, n: int) -> str:
    """Gauss-Jordan inversion of (i, j, x), one pivot a step."""
    return f"""gj(k, i, j, x) AS (SELECT CAST(-1 AS BIGINT), i, j, x FROM {table}
  UNION ALL SELECT a.k + 1, a.i, a.j, CASE WHEN a.i = a.k + 1 AND a.j = a.k + 1 THEN 1 / p.x WHEN a.i = a.k + 1 THEN a.x / p.x
    WHEN a.j = a.k + 1 THEN -a.x / p.x ELSE a.x - ci.x * rj.x / p.x END
  FROM gj a JOIN gj p ON p.i = a.k + 1 AND p.j = a.k + 1 JOIN gj ci ON ci.i = a.i AND ci.j = a.k + 1 JOIN gj rj ON rj.i = a.k + 1 AND rj.j = a.j WHERE a.k < {n - 1}),
inv AS (SELECT i, j, x FROM gj WHERE k = {n - 1})"""


_GROUND = f"""{BOTH}, lap AS (SELECT i, j, coalesce(CASE WHEN i = j THEN (SELECT sum(weight) FROM both_ways WHERE src = i) ELSE -weight END, 0.0) AS x
  FROM range(24) a(i), range(24) b(j) LEFT JOIN both_ways ON src = i AND dst = j), {_inverse("lap", 24)},
pot AS (SELECT a.i, b.j, coalesce(x, 0.0) AS x FROM range(25) a(i), range(25) b(j) LEFT JOIN inv ON inv.i = a.i AND inv.j = b.j)"""


@query(f"""WITH RECURSIVE {_GROUND} SELECT CAST(a.i AS BIGINT) AS src, CAST(b.i AS BIGINT) AS dst, round(a.x + b.x - c.x - e.x, 6) + 0.0 AS distance
FROM pot a, pot b, pot c, pot e WHERE a.i = a.j AND b.i = b.j AND c.i = a.i AND c.j = b.i AND e.i = b.i AND e.j = a.i""")
def resistance_all(spark, d):
    return rounded(ResistanceDistance()(Graph(undirected(trade(spark, d)), NATIONS)), "distance")


@query(f"""WITH RECURSIVE {_GROUND} SELECT CAST(a.i AS BIGINT) AS src, CAST(b.i AS BIGINT) AS dst, round(a.x + b.x - c.x - e.x, 6) + 0.0 AS distance
FROM pot a, pot b, pot c, pot e WHERE a.i = a.j AND b.i = b.j AND c.i = a.i AND c.j = b.i AND e.i = b.i AND e.j = a.i AND a.i IN (0, 7) AND b.i IN (3, 24)""")
def resistance_cg(spark, d):
    return rounded(ResistanceDistance(solver="cg", rtol=1e-10)(Graph(undirected(trade(spark, d)), NATIONS), [0, 7], [3, 24]), "distance")


#: Resistance between the cells of the last row: all others are eliminated one by one, each by edges between its neighbours.
_LAST_ROW = f"""WITH RECURSIVE {EDGES}, kron(k, i, j, w) AS (
  SELECT 0, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0.0 AS DOUBLE)
  UNION ALL
  SELECT any_value(k) + 1, i, j, sum(w) FROM (
    WITH cur AS (SELECT k, i, j, w FROM kron UNION ALL SELECT x.k, e.src, e.dst, e.weight FROM (SELECT DISTINCT k FROM kron) x JOIN mean_edges e ON least(e.src, e.dst) = x.k)
    SELECT k, i, j, w FROM cur WHERE i <> k AND j <> k
    UNION ALL SELECT a.k, a.i, b.j, a.w * b.w / s.w FROM cur a JOIN cur b ON a.j = a.k AND b.i = b.k AND a.i <> b.j JOIN (SELECT sum(w) AS w FROM cur WHERE i = k) s ON true)
  WHERE k < 552 GROUP BY i, j),
row_edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT i - 552 AS src, j - 552 AS dst, w AS weight FROM kron WHERE k = 552 AND i >= 0
  UNION ALL SELECT src - 552, dst - 552, weight FROM mean_edges WHERE least(src, dst) >= 552) GROUP BY 1, 2),
lap AS (SELECT i, j, coalesce(CASE WHEN i = j THEN (SELECT sum(weight) FROM row_edges WHERE src = i) ELSE -weight END, 0.0) AS x
  FROM range(23) a(i), range(23) b(j) LEFT JOIN row_edges ON src = i AND dst = j), {_inverse("lap", 23)},
pot AS (SELECT a.i, b.j, coalesce(x, 0.0) AS x FROM range(24) a(i), range(24) b(j) LEFT JOIN inv ON inv.i = a.i AND inv.j = b.j)
SELECT CAST(a.i + 552 AS BIGINT) AS src, CAST(b.i + 552 AS BIGINT) AS dst, round(a.x + b.x - c.x - e.x, 6) + 0.0 AS distance
FROM pot a, pot b, pot c, pot e WHERE a.i = a.j AND b.i = b.j AND c.i = a.i AND c.j = b.i AND e.i = b.i AND e.j = a.i"""


def _last_row(spark, d, solver: str) -> DataFrame:
    graph = mean_grid(spark, d)
    return rounded(ResistanceDistance(solver=solver, rtol=1e-10)(graph, nodes=list(range(graph.nv - SIDE, graph.nv))), "distance")


@query(_LAST_ROW)
def resistance_direct(spark, d):
    """Over the whole raster, by nested dissection."""
    return _last_row(spark, d, "direct")


@query(_LAST_ROW)
def resistance_multigrid(spark, d):
    """Over the whole raster, by conjugate gradients with a multigrid preconditioner."""
    return _last_row(spark, d, "amg")


@query(_LAST_ROW)
def resistance_blocks(spark, d):
    """Over the whole raster, by conjugate gradients with the inverses of square blocks."""
    return _last_row(spark, d, "cg")


@query(f"""WITH RECURSIVE {_GROUND} SELECT CAST(i AS BIGINT) AS id, round(sum(x * (n_regionkey + 1)), 6) AS value FROM inv JOIN nation ON j = n_nationkey GROUP BY 1""")
def linear_solve_query(spark, d):
    free = spark.range(NATIONS - 1).select("id")
    lap = algebra.submatrix(algebra.laplacian(undirected(trade(spark, d))), free, free)
    b = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 24").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1.0).alias("value"))
    return rounded(linear_solve(lap, b), "value")


_WALK = f"""{TRADE}, step AS (SELECT src, dst, -ln(weight) AS cost, weight / sum(weight) OVER (PARTITION BY src) * exp(0.5 * ln(weight)) AS w FROM trade),
m AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END - coalesce(w, 0.0) AS x FROM range(25) a(i), range(25) b(j) LEFT JOIN step ON src = i AND dst = j),
{_inverse("m", 25)}, cz AS (SELECT src AS i, j, sum(cost * w * x) AS y FROM step JOIN inv ON dst = inv.i GROUP BY 1, 2),
zcz AS (SELECT inv.i, cz.j, sum(inv.x * cz.y) AS y FROM inv JOIN cz ON inv.j = cz.i GROUP BY 1, 2),
e AS (SELECT zcz.i, zcz.j, y / x AS d FROM zcz JOIN inv ON inv.i = zcz.i AND inv.j = zcz.j WHERE x <> 0)"""


@query(f"""WITH RECURSIVE {_WALK} SELECT CAST(e.i AS BIGINT) AS src, CAST(e.j AS BIGINT) AS dst, round(e.d - o.d, 6) + 0.0 AS distance
FROM e JOIN e o ON o.i = e.j AND o.j = e.j WHERE e.j IN (2, 11)""")
def rsp_to_targets(spark, d):
    return rounded(RSPDistance(0.5, method="direct")(Graph(trade(spark, d), NATIONS), targets=[2, 11]), "distance")


@query(f"""WITH RECURSIVE {_WALK} SELECT CAST(e.i AS BIGINT) AS src, CAST(e.j AS BIGINT) AS dst, round(e.d - o.d, 6) + 0.0 AS distance
FROM e JOIN e o ON o.i = e.j AND o.j = e.j WHERE e.j = 4 AND e.i IN (0, 1, 2)""")
def rsp_by_walks(spark, d):
    return rounded(RSPDistance(0.5, method="walks")(Graph(trade(spark, d), NATIONS), [0, 1, 2], [4]), "distance")


# --- windows (W) ------------------------------------------------------------------------------

WINDOW, BUFFER = 4, 2


def spec(r: Raster) -> windows.WindowSpec:
    return windows.WindowSpec(r.shape, WINDOW, BUFFER)


_WIN = f"""{RAST}, win AS (SELECT CAST(x * 5 + y AS BIGINT) AS id, CAST(x * 4 AS INTEGER) AS x0, CAST(y * 4 AS INTEGER) AS y0 FROM range(5) a(x), range(5) b(y))"""


@query(f'WITH {RAST} SELECT CAST(a.i AS INTEGER) AS "row", CAST(b.j AS INTEGER) AS "col", round(coalesce(p, 0.0), 6) AS value FROM range(25) a(i), range(25) b(j) LEFT JOIN rast ON r = i AND c = j')
def pad_raster(spark, d):
    return rounded(rast(spark, d).pad(2, 7).cells, "value")


@query(f"WITH {_WIN} SELECT id AS window_id, x0, y0 FROM win")
def window_index(spark, d):
    return spec(rast(spark, d)).table(spark)


@query(f'WITH {_WIN} SELECT id AS window_id, r AS "row", c AS "col", r - x0 AS local_row, c - y0 AS local_col, round(p, 6) AS value FROM win JOIN rast ON r BETWEEN x0 AND x0 + 7 AND c BETWEEN y0 AND y0 + 7')
def total_windows(spark, d):
    r = rast(spark, d)
    return rounded(spec(r).total_cells(r.cells), "value")


@query(f'WITH {_WIN} SELECT id AS window_id, r AS "row", c AS "col", r - x0 - 2 AS local_row, c - y0 - 2 AS local_col, round(p, 6) AS value FROM win JOIN rast ON r BETWEEN x0 + 2 AND x0 + 5 AND c BETWEEN y0 + 2 AND y0 + 5')
def core_windows(spark, d):
    r = rast(spark, d)
    return rounded(spec(r).core_cells(r.cells), "value")


@query(f'WITH {_WIN} SELECT r AS "row", c AS "col", round(CASE WHEN r BETWEEN 2 AND 21 AND c BETWEEN 2 AND 21 THEN 2 * p ELSE p END, 6) AS value FROM rast')
def merge_core(spark, d):
    r = rast(spark, d)
    return rounded(windows.merge_cores(r, spec(r).core_cells(r.map(lambda v: 2 * v).cells)).cells, "value")


@query(f'WITH {_WIN} SELECT r AS "row", c AS "col", round(sum(p * (id + 1)), 6) AS value FROM win JOIN rast ON r BETWEEN x0 AND x0 + 7 AND c BETWEEN y0 AND y0 + 7 GROUP BY 1, 2')
def overlap_add(spark, d):
    r = rast(spark, d)
    return rounded(windows.overlap_add(spec(r).total_cells(r.cells).withColumn("value", F.col("value") * (F.col("window_id") + 1))), "value")


@query(f'WITH {_WIN} SELECT r AS "row", c AS "col", round(max(id) + p, 6) AS value FROM win JOIN rast ON r BETWEEN x0 AND x0 + 7 AND c BETWEEN y0 AND y0 + 7 GROUP BY r, c, p')
def overlap_last(spark, d):
    r = rast(spark, d)
    return rounded(windows.overlap_last(spec(r).total_cells(r.cells).withColumn("value", F.col("value") + F.col("window_id"))), "value")


# --- connectivity (C) -------------------------------------------------------------------------


def both_rasters(spark, d) -> tuple[Raster, Raster]:
    return rast(spark, d, "q"), rast(spark, d)


@query(f"""WITH {RAST} SELECT round(sum(a.q * b.q * exp(-sqrt(CAST((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS DOUBLE)) / 2)), 6) AS connectivity
FROM rast a, rast b WHERE abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 AND (a.r <> b.r OR a.c <> b.c) AND a.r BETWEEN 3 AND 20 AND a.c BETWEEN 3 AND 20""")
def connectivity_euclid(spark, d):
    q, p = both_rasters(spark, d)
    return rounded(ConnectivityAnalysis(q, p, EuclideanDistance(), Exponential(2.0), 3, 6).run(), "connectivity")


@query(f"""WITH {RAST} SELECT CAST(sum(CASE WHEN (i * i + j * j) < 9 THEN 1 ELSE 0 END) AS DOUBLE) AS connectivity
FROM range(20) x(r), range(20) y(c), range(-3, 4) a(i), range(-3, 4) b(j) WHERE i <> 0 OR j <> 0""")
def connectivity_unweighted(spark, d):
    q, p = both_rasters(spark, d)  # padded to 26 x 26: 20 x 20 windows, those in the padding count too
    return ConnectivityAnalysis(q, p, EuclideanDistance(), Threshold(3.0), 3, 5).run(q_weighted=False)


@query(f"""WITH {RAST}, w AS (SELECT x, y FROM range(6) a(x), range(6) b(y)),
core AS (SELECT x, y, sum(q) AS q FROM w JOIN rast ON r BETWEEN 3 * x + 2 AND 3 * x + 4 AND c BETWEEN 3 * y + 2 AND 3 * y + 4 GROUP BY 1, 2),
rest AS (SELECT x, y, sum(q * exp(-sqrt(CAST((r - 3 * x - 3) * (r - 3 * x - 3) + (c - 3 * y - 3) * (c - 3 * y - 3) AS DOUBLE)) / 2)) AS k FROM w
  JOIN rast ON r BETWEEN 3 * x AND 3 * x + 6 AND c BETWEEN 3 * y AND 3 * y + 6 AND NOT (r BETWEEN 3 * x + 2 AND 3 * x + 4 AND c BETWEEN 3 * y + 2 AND 3 * y + 4) GROUP BY 1, 2),
more AS (SELECT x, y FROM range(7) a(x), range(7) b(y))
SELECT round(sum(core.q * rest.k), 6) AS connectivity FROM
  (SELECT x, y, sum(q) AS q FROM more JOIN rast ON r BETWEEN 3 * x + 2 AND 3 * x + 4 AND c BETWEEN 3 * y + 2 AND 3 * y + 4 GROUP BY 1, 2) core JOIN
  (SELECT x, y, sum(q * exp(-sqrt(CAST((r - 3 * x - 3) * (r - 3 * x - 3) + (c - 3 * y - 3) * (c - 3 * y - 3) AS DOUBLE)) / 2)) AS k FROM more
   JOIN rast ON r BETWEEN 3 * x AND 3 * x + 6 AND c BETWEEN 3 * y AND 3 * y + 6 AND NOT (r BETWEEN 3 * x + 2 AND 3 * x + 4 AND c BETWEEN 3 * y + 2 AND 3 * y + 4) GROUP BY 1, 2) rest USING (x, y)""")
def connectivity_coarse(spark, d):
    q, p = both_rasters(spark, d)
    return rounded(ConnectivityAnalysis(q, p, EuclideanDistance(), Exponential(2.0), 3, 7, coarsening_factor=0.7).run(), "connectivity")


_WINDOW_LCP = f"""{EDGES}, centre AS (SELECT r, c, CAST(r * 24 + c AS BIGINT) AS s FROM rast WHERE r BETWEEN 2 AND 21 AND c BETWEEN 2 AND 21),
best(s, v, d) USING KEY (s, v) AS (SELECT s, s, CAST(0.0 AS DOUBLE) FROM centre
  UNION SELECT b.s, e.dst, min(b.d + 1 / e.weight) FROM best b JOIN mean_edges e ON b.v = e.src LEFT JOIN recurring.best k ON k.s = b.s AND k.v = e.dst
  WHERE abs(e.dst // 24 - b.s // 24) <= 2 AND abs(e.dst % 24 - b.s % 24) <= 2 AND (k.d IS NULL OR b.d + 1 / e.weight < k.d) GROUP BY b.s, e.dst)"""


@query(f"""WITH RECURSIVE {_WINDOW_LCP} SELECT round(sum(a.q * b.q * CASE WHEN d < 6 THEN exp(-d / 3) ELSE 0 END), 6) AS connectivity
FROM best JOIN rast a ON s = a.r * 24 + a.c JOIN rast b ON v = b.r * 24 + b.c WHERE s <> v""")
def connectivity_lcp(spark, d):
    q, p = both_rasters(spark, d)
    return rounded(ConnectivityAnalysis(q, p, LCPDistance(), TruncatedExponential(3.0, 6.0), 2, 5).run(), "connectivity")


class LargerStep(Distance):
    """A user's own metric: the larger of the differences of rows and columns, which permeability plays no part in."""

    def between(self, graph, sources, targets):
        everyone = graph.edges().sparkSession.range(graph.nv).select("id")
        at = lambda side, c: (everyone if side is None else side).select(F.col("id").alias(c))
        places = [(F.floor(F.col(c) / graph.width), F.pmod(F.col(c), F.lit(graph.width))) for c in ("src", "dst")]
        apart = [F.abs(a - b) for a, b in zip(*places, strict=True)]
        return at(sources, "src").crossJoin(at(targets, "dst")).select("src", "dst", F.greatest(*apart).cast("double").alias("distance"))

    def in_windows(self, p):
        _, h, w = p.shape
        d = np.maximum(np.abs(np.arange(h) - h // 2)[:, None], np.abs(np.arange(w) - w // 2)[None, :]).astype(float)
        return np.broadcast_to(d, p.shape), np.zeros_like


@query(f"""WITH {RAST} SELECT round(sum(a.q * b.q * exp(-greatest(abs(a.r - b.r), abs(a.c - b.c)) / 2)), 6) AS connectivity FROM rast a, rast b
WHERE a.r BETWEEN 3 AND 20 AND a.c BETWEEN 3 AND 20 AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 AND (a.r <> b.r OR a.c <> b.c)""")
def connectivity_own_metric(spark, d):
    q, p = both_rasters(spark, d)
    return rounded(ConnectivityAnalysis(q, p, LargerStep(), Exponential(2.0), 3, 6).run(), "connectivity")


_EUCLID_GRADIENT = f"""{RAST}, pair AS (SELECT a.r AS ar, a.c AS ac, b.r AS br, b.c AS bc, a.q AS aq, b.q AS bq,
  exp(-sqrt(CAST((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS DOUBLE)) / 2) AS k FROM rast a, rast b
  WHERE abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 AND (a.r <> b.r OR a.c <> b.c) AND a.r BETWEEN 3 AND 20 AND a.c BETWEEN 3 AND 20),
grad AS (SELECT r, c, sum(g) AS g FROM (SELECT br AS r, bc AS c, aq * k AS g FROM pair UNION ALL SELECT ar, ac, bq * k FROM pair) GROUP BY 1, 2)"""


@query(f'WITH {_EUCLID_GRADIENT} SELECT rast.r AS "row", rast.c AS "col", round(coalesce(g, 0.0), 6) AS sensitivity FROM rast LEFT JOIN grad ON rast.r = grad.r AND rast.c = grad.c')
def sensitivity_quality(spark, d):
    q, p = both_rasters(spark, d)
    return rounded(SensitivityAnalysis(q, p, EuclideanDistance(), Exponential(2.0), 3, 6).run("quality"), "sensitivity")


@query()
def sensitivity_permeability(spark, d):
    q, p = both_rasters(spark, d)
    return rounded(SensitivityAnalysis(q, p, LCPDistance(), Exponential(3.0), 2, 5).run("permeability"), "sensitivity")


@query()
def sensitivity_resistance(spark, d):
    q, p = both_rasters(spark, d)
    return rounded(SensitivityAnalysis(q, p, ResistanceDistance(), Exponential(3.0), 2, 5).run("permeability"), "sensitivity")


@query()
def sensitivity_rsp(spark, d):
    q, p = both_rasters(spark, d)
    return rounded(SensitivityAnalysis(q, p, RSPDistance(0.1), Exponential(3.0), 2, 5).run("permeability"), "sensitivity")


# --- landmarks and workflow (N, X) ------------------------------------------------------------


@query(f"""WITH {RAST} SELECT t.r AS "row", t.c AS "col", round(sum(rast.p), 6) AS value FROM rast t JOIN rast ON abs(rast.r - t.r) <= 2 AND abs(rast.c - t.c) <= 2 GROUP BY 1, 2""")
def sum_neighborhood(spark, d):
    r = rast(spark, d)
    return rounded(landmarks.sum_neighborhood(r, r.cells, 2), "value")


@query(f'WITH {RAST} SELECT CAST(r // 3 * 3 + 1 AS INTEGER) AS "row", CAST(c // 3 * 3 + 1 AS INTEGER) AS "col", round(sum(p) / 9, 6) AS value FROM rast GROUP BY 1, 2')
def coarse_grain(spark, d):
    return rounded(landmarks.coarse_grain(rast(spark, d), 1).cells, "value")


@query(f'WITH {RAST} SELECT r AS "row", c AS "col", round(p / 2 + 0.001, 6) AS value FROM rast')
def scale_fill(spark, d):
    return rounded(workflow.scale_fill(rast(spark, d), 2.0, 0.001).cells, "value")


@query(f'WITH {RAST} SELECT r AS "row", c AS "col", CASE WHEN p > 0.5 THEN round(q, 6) END AS value FROM rast')
def mask_barriers(spark, d):
    q, p = both_rasters(spark, d)
    return rounded(workflow.mask_barriers(q.cells, p, 0.5), "value")


@query(f'WITH {_EUCLID_GRADIENT} SELECT rast.r AS "row", rast.c AS "col", round(coalesce(g, 0.0) * q, 6) AS elasticity FROM rast LEFT JOIN grad ON rast.r = grad.r AND rast.c = grad.c')
def elasticity(spark, d):
    q, p = both_rasters(spark, d)
    return rounded(workflow.elasticity(SensitivityAnalysis(q, p, EuclideanDistance(), Exponential(2.0), 3, 6).run("quality"), q), "elasticity")


@query(f'WITH {RAST} SELECT r AS "row", c AS "col" FROM rast WHERE p >= (SELECT quantile_cont(p, 0.95) FROM rast)')
def percentile_select(spark, d):
    return workflow.above_percentile(rast(spark, d).cells, "value").select("row", "col")


@query()
def hash_sample(spark, d):
    return workflow.sample_cells(rast(spark, d).cells, 30).select("row", "col")


@query(f"""WITH {RAST}, after AS (SELECT r, c, CASE WHEN r < 12 THEN q * 1.5 ELSE q END AS q FROM rast), one AS
(SELECT sum(a.q * b.q * exp(-sqrt(CAST((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS DOUBLE)) / 2)) AS v FROM rast a, rast b
 WHERE abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 AND (a.r <> b.r OR a.c <> b.c) AND a.r BETWEEN 3 AND 20 AND a.c BETWEEN 3 AND 20), two AS
(SELECT sum(a.q * b.q * exp(-sqrt(CAST((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS DOUBLE)) / 2)) AS v FROM after a, after b
 WHERE abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 AND (a.r <> b.r OR a.c <> b.c) AND a.r BETWEEN 3 AND 20 AND a.c BETWEEN 3 AND 20)
SELECT round(one.v, 6) AS before, round(two.v, 6) AS after, round(100 * (two.v - one.v) / one.v, 6) AS gain FROM one, two""")
def scenario_gain(spark, d):
    q, p = both_rasters(spark, d)
    run = lambda x: ConnectivityAnalysis(x, p, EuclideanDistance(), Exponential(2.0), 3, 6).run()
    changed = workflow.update_cells(q, q.cells.where("row < 12").withColumn("value", F.col("value") * 1.5))
    return rounded(workflow.percent_gain(run(q), run(changed)), "before", "after", "gain")


@query("SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS class_id FROM part")
def class_ids(spark, d):
    return workflow.class_ids(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "p_brand", F.col("class_id").cast("long").alias("class_id"))


@query(f"""WITH {RAST} SELECT CAST(r // 5 AS INTEGER) AS "row", CAST(c // 5 AS INTEGER) AS "col", CAST(floor(p * 10) AS BIGINT) AS class_id, round(count(*) / 25.0, 6) AS value
FROM rast WHERE r < 20 AND c < 20 GROUP BY 1, 2, 3""")
def one_hot_block_mean(spark, d):
    classes = rast(spark, d).cells.withColumn("class_id", F.floor(F.col("value") * 10))
    return rounded(workflow.block_mean(workflow.one_hot_classes(classes), 5, SIDE, SIDE, ["class_id"]), "value")


@query("""WITH s AS (SELECT s_suppkey, s_acctbal % 240 / 10 AS x, CAST(s_suppkey % 24 AS DOUBLE) + 0.5 AS y FROM supplier)
SELECT s_suppkey, (SELECT CAST(arg_min(i, abs(i - y) * 1000000 + i) AS INTEGER) FROM range(24) t(i)) AS "row",
       (SELECT CAST(arg_min(i, abs(i - x) * 1000000 + i) AS INTEGER) FROM range(24) t(i)) AS "col" FROM s""")
def nearest_cell(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_acctbal") % 240 / 10).alias("x"), ((F.col("s_suppkey") % 24).cast("double") + 0.5).alias("y"))
    return workflow.nearest_cell(s, range(SIDE), range(SIDE)).select("s_suppkey", "row", "col")


@query("SELECT CAST(a.n_nationkey AS BIGINT) AS i, CAST(b.n_nationkey AS BIGINT) AS j FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def unordered_pairs(spark, d):
    return workflow.unordered_pairs(spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id")))


@query(f"""WITH {RAST}, f AS (SELECT avg((p - q * 10) * (p - q * 10)) AS mse, var_pop(p) AS v FROM rast)
SELECT round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(1 - mse / v, 4) AS r2 FROM f""")
def fit_figures(spark, d):
    q, p = both_rasters(spark, d)
    both = p.cells.withColumnRenamed("value", "observed").join(q.cells.select("row", "col", (F.col("value") * 10).alias("predicted")), ["row", "col"])
    return rounded(workflow.fit_figures(both).withColumn("r2", F.round("r2", 4)), "mse", "rmse")


@query(f"""WITH {RAST}, l AS (SELECT r, c, ln(p) AS v FROM rast WHERE p > 0)
SELECT r AS "row", c AS "col", round(least(greatest(v, (SELECT quantile_cont(v, 0.1) FROM l)), (SELECT quantile_cont(v, 0.9) FROM l)), 6) AS clipped FROM l""")
def clipped_log(spark, d):
    return rounded(workflow.clipped_log(rast(spark, d).cells, "value").select("row", "col", "clipped"), "clipped")


@query(f"WITH RECURSIVE {_GROUND} SELECT round(sum((a.x + b.x - c.x - e.x) * (a.x + b.x - c.x - e.x)), 6) AS objective FROM pot a, pot b, pot c, pot e "
       "WHERE a.i = a.j AND b.i = b.j AND c.i = a.i AND c.j = b.i AND e.i = b.i AND e.j = a.i")
def squared_sum(spark, d):
    found = ResistanceDistance()(Graph(undirected(trade(spark, d)), NATIONS), nodes=list(range(NATIONS)))
    return rounded(workflow.squared_sum(found), "objective")


@query(f'WITH {RAST} SELECT r AS "row", c AS "col", round(least(exp(2 * p - q), 1000), 6) AS predicted FROM rast')
def predict_cells(spark, d):
    q, p = both_rasters(spark, d)
    both = p.cells.withColumnRenamed("value", "p").join(q.cells.withColumnRenamed("value", "q"), ["row", "col"])
    return rounded(workflow.predict_cells(both, ["p", "q"], lambda x: 2 * x[:, 0] - x[:, 1]).select("row", "col", "predicted"), "predicted")


@query()
def train_split(spark, d):
    return workflow.split_rows(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey"), ["n_nationkey"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-cost-path distances from the first cell of the derived raster."""
    return lcp_single(spark, sf_dir)
