"""Connected components of an edge table, by alternating stars.

Each round links every vertex's larger neighbours, then its smaller ones, to the least of them; the
table shrinks to stars around each component's least vertex in a number of rounds that grows with
the logarithm of its size.  Only minima are aggregated, neighbour lists never are.  Rounds are cut
by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _large(edges: DataFrame) -> DataFrame:
    """(v, m) for every neighbour v > u of u, m the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """(u, m) and (v, m) for every smaller neighbour v of u, m the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    inner = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) of every vertex of ``edges`` (u, v): the least vertex of its component."""
    now = stage(edges.select("u", "v").where("u <> v").distinct(), "components")
    mark = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was, seen = None, mark(now)
    while seen != was:
        now = stage(_small(_large(now)), "components")
        was, seen = seen, mark(now)
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(now.select("v", "v").distinct().toDF("id", "label")).distinct()
