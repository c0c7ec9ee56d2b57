"""Algebraic multigrid for symmetric positive definite edge tables, as a preconditioner.

Setup: vertices are put together around roots, those whose hash is the largest within two strong edges, found by joins; vertices
not adjacent to an aggregate then find roots among themselves, round after round, until all are placed.  The constant on each
such aggregate, smoothed once by Jacobi, gives the prolongation P, and the next level's matrix is P' A P, two joins.
Levels go on until ``COARSE`` unknowns are left, whose inverse is dense.

A V-cycle with one Jacobi step G = I - w A D^-1 before and one after the coarse level is, for a residual r,
c = (P' G) r, x solved on the coarse level, and z = w (G' + I) D^-1 r + (G' P) x.  So the two matrices w (G' + I) D^-1 and
G' P are worked out in the setup, and applying a level takes three joins and two sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Unknowns of the last level, the weight of a Jacobi step, and when an edge is strong (halved on each level).
COARSE, OMEGA, STRONG = 500, 2 / 3, 0.08


def _near(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(id, m): the largest m over a vertex and its neighbours."""
    met = edges.join(values.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "m")
    return met.unionByName(values).groupBy("id").agg(F.max("m").alias("m"))


def aggregates(strong: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, root): every vertex and the root of its aggregate, from the strong edges (src, dst, weight), in both directions.

    A vertex joins the adjacent aggregate to which its strongest edge leads; one without any strong edge is alone.
    """
    placed = None
    left = ids
    while True:
        among = strong.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi")
        rank = left.select("id", F.struct(F.xxhash64("id").alias("h"), "id").alias("m"))
        roots = _near(among, _near(among, rank)).join(rank.withColumnRenamed("m", "own"), "id").where("m = own").select("id", F.col("id").alias("root"))
        roots = materialize(roots, "roots")
        placed = roots if placed is None else placed.unionByName(roots)
        for _ in range(2):
            rest = ids.join(placed, "id", "left_anti")
            to = strong.join(rest.withColumnRenamed("id", "src"), "src", "left_semi").join(placed.withColumnRenamed("id", "dst"), "dst")
            near = to.groupBy(F.col("src").alias("id")).agg(F.max(F.struct(F.abs("weight"), "root")).alias("r")).select("id", F.col("r.root").alias("root"))
            placed = materialize(placed.unionByName(near), "aggregates")
        left = materialize(ids.join(placed, "id", "left_anti"), "unplaced")
        if left.isEmpty():
            return placed


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two sparse matrices (src, dst, weight)."""
    met = a.select("src", F.col("dst").alias("k"), F.col("weight").alias("x")).join(b.select(F.col("src").alias("k"), "dst", F.col("weight").alias("y")), "k")
    return met.groupBy("src", "dst").agg(F.sum(F.col("x") * F.col("y")).alias("weight"))


def _flip(a: DataFrame) -> DataFrame:
    return a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def _times(a: DataFrame, vectors: DataFrame) -> DataFrame:
    """(rhs, id, v): summands of a sparse matrix times vectors (rhs, id, v)."""
    return a.join(vectors.withColumnRenamed("id", "dst"), "dst").select("rhs", F.col("src").alias("id"), (F.col("weight") * F.col("v")).alias("v"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rhs", "id").agg(F.sum("v").alias("v"))


@dataclass
class Multigrid:
    """(smoother, prolongation) of each level, and the dense inverse of the last with its ids."""

    levels: list[tuple[DataFrame, DataFrame]]
    ids: np.ndarray
    inverse: np.ndarray
    sizes: list[int]

    def __call__(self, residuals: DataFrame, parts: int = 1) -> DataFrame:
        """(rhs, id, z): a V-cycle for the residuals (rhs, id, r)."""
        return self._cycle(0, residuals.select("rhs", "id", F.col("r").alias("v")), parts).withColumnRenamed("v", "z")

    def _cycle(self, n: int, r: DataFrame, parts: int) -> DataFrame:
        if n == len(self.levels):
            ids, inverse = self.ids, self.inverse

            def divide(table: pd.DataFrame) -> pd.DataFrame:
                sides = np.unique(table["rhs"])
                b = np.zeros((len(ids), len(sides)))
                np.add.at(b, (np.searchsorted(ids, table["id"]), np.searchsorted(sides, table["rhs"])), table["v"].to_numpy())
                return pd.DataFrame({"rhs": np.tile(sides, len(ids)), "id": np.repeat(ids, len(sides)), "v": (inverse @ b).ravel()})

            part = F.pmod(F.xxhash64("rhs"), F.lit(parts)).alias("part")
            return r.select("rhs", "id", "v", part).groupBy("part").applyInPandas(divide, "rhs long, id long, v double")
        smooth, prolong = self.levels[n]
        coarse = self._cycle(n + 1, _summed(_times(_flip(prolong), r)), parts)
        return _summed(_times(smooth, r).unionByName(_times(prolong, coarse)))


def multigrid(matrix: DataFrame, coarse: int = COARSE) -> Multigrid:
    """Set up levels for a symmetric positive definite matrix (src, dst, weight)."""
    now = materialize(matrix.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "level")
    levels, sizes, strong = [], [], STRONG
    while True:
        diagonal = materialize(now.where("src = dst").select(F.col("src").alias("id"), F.col("weight").alias("d")), "diagonal")
        sizes.append(diagonal.count())
        if sizes[-1] <= coarse or len(sizes) > 1 and sizes[-1] > 0.9 * sizes[-2]:
            break
        of = lambda c: diagonal.select(F.col("id").alias(c), F.col("d").alias(f"d_{c}"))
        scaled = now.join(of("src"), "src").join(of("dst"), "dst")
        edges = scaled.where("src <> dst").where(F.abs("weight") >= strong * F.sqrt(F.col("d_src") * F.col("d_dst"))).select("src", "dst", "weight")
        roots = aggregates(materialize(edges, "strong"), diagonal.select("id"))
        one = F.when(F.col("src") == F.col("dst"), 1.0).otherwise(0.0)
        jacobi = materialize(scaled.select("src", "dst", (one - OMEGA * F.col("weight") / F.col("d_src")).alias("weight")), "jacobi")  # G'
        tentative = roots.select(F.col("id").alias("src"), F.col("root").alias("dst"), F.lit(1.0).alias("weight"))
        prolong = materialize(_product(jacobi, tentative), "prolongation")
        both = jacobi.join(of("dst"), "dst").select("src", "dst", (OMEGA * (F.col("weight") + one) / F.col("d_dst")).alias("weight"))
        levels.append((materialize(both, "smoother"), materialize(_product(jacobi, prolong), "smoothed")))
        now = materialize(_product(_flip(prolong), _product(now, prolong)), "level")
        strong /= 2
    if sizes[-1] > 4 * coarse:
        raise ValueError(f"{sizes[-1]} unknowns are left that strong edges do not put together; {4 * coarse} at most")
    last = now.toPandas()  # at most 4 * coarse unknowns
    ids = np.unique(last["src"])
    dense = np.zeros((len(ids), len(ids)))
    dense[np.searchsorted(ids, last["src"]), np.searchsorted(ids, last["dst"])] = last["weight"]
    return Multigrid(levels, ids, np.linalg.inv(dense), sizes)
