"""Sparse matrices as edge tables (src, dst, weight): row, column, value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialize


def canonicalize(edges: DataFrame) -> DataFrame:
    """One entry for each place: duplicates are summed, zeros dropped."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).where("weight <> 0")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): row sums."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))


def laplacian(edges: DataFrame) -> DataFrame:
    """The row sums on the diagonal, less the matrix."""
    diagonal = degree(edges).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("degree").alias("weight"))
    return canonicalize(diagonal.unionByName(edges.select("src", "dst", (-F.col("weight")).alias("weight"))))


def map_nonzero(edges: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """``f`` of the entries above zero; the others, negative ones too, become zero and go."""
    return edges.where("weight > 0").withColumn("weight", f(F.col("weight")))


def diagonal(vector: DataFrame) -> DataFrame:
    """The matrix with (id, value) on its diagonal."""
    return vector.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("value").alias("weight"))


def tril(edges: DataFrame, k: int = 0) -> DataFrame:
    """Entries on and below the k-th diagonal."""
    return edges.where(F.col("dst") - F.col("src") <= k)


def triu(edges: DataFrame, k: int = 0) -> DataFrame:
    """Entries on and above the k-th diagonal."""
    return edges.where(F.col("dst") - F.col("src") >= k)


def set_at(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace or add the entries of ``updates`` (src, dst, weight)."""
    kept = edges.join(updates.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "weight")
    return kept.unionByName(updates.select("src", "dst", "weight"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def normalize_rows(edges: DataFrame) -> DataFrame:
    """Each row divided by its sum: the random walk on the graph."""
    return edges.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy("src")))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of entries."""
    return a.join(b.withColumnRenamed("weight", "_b"), ["src", "dst"]).select("src", "dst", (F.col("weight") * F.col("_b")).alias("weight"))


def submatrix(edges: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The entries whose row and column are in the vertex tables (id)."""
    inside = edges.join(rows.select(F.col("id").alias("src")), "src", "left_semi").join(columns.select(F.col("id").alias("dst")), "dst", "left_semi")
    return inside.select("src", "dst", "weight")


def one_hot(nodes: DataFrame, nv: int) -> DataFrame:
    """(id, rhs, value): a unit vector for each node; one outside 0..nv-1 has no entries."""
    return nodes.where((F.col("id") >= 0) & (F.col("id") < nv)).select("id", F.col("id").alias("rhs"), F.lit(1.0).alias("value"))


def spmv(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """The matrix times each right-hand side of (id, [rhs,] value)."""
    keys = [c for c in ("rhs",) if c in vector.columns]
    met = edges.join(vector.withColumnRenamed("id", "dst"), "dst")
    return met.groupBy(F.col("src").alias("id"), *keys).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, label): the least vertex of each weak component, over non-zero edges that are no loops.

    Labels are spread by stars: every vertex hands the least label it sees to all its neighbours
    and to its own label's vertex, so the number of rounds grows with the logarithm of a component.
    """
    plain = edges.where("weight <> 0") if "weight" in edges.columns else edges
    ends = plain.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ends = (ends if vertices is None else ends.unionByName(vertices.select("id"))).distinct()
    pairs = plain.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, was = materialize(pairs, "stars"), None
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen != was:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        was, seen = seen, mark(now)
    return ends.join(now.select(F.col("u").alias("id"), F.col("v").alias("_l")), "id", "left").select("id", F.coalesce("_l", "id").alias("label"))


def largest_component(labels: DataFrame) -> DataFrame:
    """(label, n): the most frequent label, of equally frequent ones the least."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1)


def prune(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The subgraph of the vertices ``keep`` (id), under their own ids."""
    return submatrix(edges, keep, keep)


def reindex(edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``prune`` under ids 0, 1, ... in the order of the old ones, and the table (id, new_id)."""
    ids = keep.select("id").distinct()
    bounded = ids.repartitionByRange("id").withColumn("p", F.spark_partition_id())
    bounded = materialize(bounded.withColumn("n", F.row_number().over(W.partitionBy("p").orderBy("id"))), "reindex")
    starts = bounded.groupBy("p").count().withColumn("s", F.sum("count").over(W.orderBy("p")) - F.col("count"))
    table = bounded.join(F.broadcast(starts.select("p", "s")), "p").select("id", (F.col("s") + F.col("n") - 1).alias("new_id"))
    out = edges.join(table.select(F.col("id").alias("src"), F.col("new_id").alias("a")), "src").join(table.select(F.col("id").alias("dst"), F.col("new_id").alias("b")), "dst")
    return out.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), table
