"""Gradients of objectives over whole graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize


def path_sum_gradient(edges: DataFrame, distances: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(src, dst, gradient): of a weighted sum of least-cost distances by the weight of each edge that is on a path.

    ``edges`` (src, dst, weight) cost 1 / weight; ``distances`` (src, dst, distance) are those of some sources to all vertices;
    ``pairs`` (src, dst, share) says what counts how often, by default every distance once.

    The last edges of the paths from a source make a tree (of equally short ways the one by the smaller vertex).  What counts below
    each vertex is summed up the tree by pointer doubling: in a round each vertex gets the sums of those whose pointer
    leads to it, and then every pointer goes as far again, so rounds grow with the logarithm of a path's edges.
    """
    reached = materialize(distances.select(F.col("src").alias("s"), F.col("dst").alias("v"), "distance"), "reached")
    steps = edges.select(F.col("src").alias("u"), F.col("dst").alias("to"), (1.0 / F.col("weight")).alias("cost"))
    last = reached.withColumnRenamed("v", "u").join(steps, "u").where("to <> s").groupBy("s", F.col("to").alias("v")).agg(F.min(F.struct((F.col("distance") + F.col("cost")).alias("d"), "u")).alias("r"))
    last = materialize(last.select("s", "v", F.col("r.u").alias("u")), "trees")
    if pairs is None:
        counted = reached.select("s", "v", F.lit(1.0).alias("n"))
    else:
        counted = reached.select("s", "v").join(pairs.select(F.col("src").alias("s"), F.col("dst").alias("v"), F.col("share").cast("double").alias("n")), ["s", "v"], "left")
    state = counted.join(last.withColumnRenamed("u", "up"), ["s", "v"], "left").select("s", "v", "up", F.coalesce("n", F.lit(0.0)).alias("n"))
    state = materialize(state, "sums")
    while not state.where("up is not null").isEmpty():
        came = state.where("up is not null").groupBy("s", F.col("up").alias("v")).agg(F.sum("n").alias("more"))
        on = state.select("s", F.col("v").alias("up"), F.col("up").alias("next"))
        moved = state.join(came, ["s", "v"], "left").join(on, ["s", "up"], "left")
        state = materialize(moved.select("s", "v", F.col("next").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0.0))).alias("n")), "sums")
    used = last.join(state.select("s", "v", "n"), ["s", "v"]).groupBy(F.col("u").alias("src"), F.col("v").alias("dst")).agg(F.sum("n").alias("n"))
    return used.join(edges, ["src", "dst"]).select("src", "dst", (-F.col("n") / (F.col("weight") * F.col("weight"))).alias("gradient"))
