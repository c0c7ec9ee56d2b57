"""Linear systems: preconditioned conjugate gradients over edge tables, dense solves in a task, and a choice of all solvers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .direct import factorize
from .multigrid import multigrid
from .store import materialize
from .tiles import Tiling

DENSE_LIMIT = 2_000
#: The side of the tiles whose blocks make a preconditioner, and right-hand sides that it is applied to together.
TILE_SIDE, SIDES = 16, 1_024
#: From (rhs, id, r) and a number of parts to (rhs, id, z).
Preconditioner = Callable[[DataFrame, int], DataFrame]
#: From a matrix (src, dst, weight) and right-hand sides (id, rhs, value) to (id, rhs, value).
Solver = Callable[[DataFrame, DataFrame], DataFrame]


def _packed_block(tile: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """One row for a tile: its unknowns and the inverse of its block (src, dst, weight) of the matrix."""
    ids = np.unique(block["src"])
    a = np.zeros((len(ids), len(ids)))
    np.add.at(a, (np.searchsorted(ids, block["src"]), np.searchsorted(ids, block["dst"])), block["weight"])
    return pd.DataFrame({"of_tile": [tile[0]], "ids": [ids], "inverse": [np.linalg.inv(a).tobytes()]})


def _divide(residuals: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """(rhs, id, z): the residuals (rhs, id, r) of a tile times the inverse of its block."""
    if not len(residuals) or not len(blocks):
        return pd.DataFrame({"rhs": [], "id": [], "z": []}).astype({"rhs": "int64", "id": "int64"})
    ids, columns = np.asarray(blocks["ids"].iloc[0]), np.unique(residuals["rhs"])
    r = np.zeros((len(ids), len(columns)))
    np.add.at(r, (np.searchsorted(ids, residuals["id"]), np.searchsorted(columns, residuals["rhs"])), residuals["r"])
    z = np.frombuffer(blocks["inverse"].iloc[0]).reshape(len(ids), -1) @ r
    return pd.DataFrame({"rhs": np.tile(columns, len(ids)), "id": np.repeat(ids, len(columns)), "z": z.ravel()})


def block_inverses(matrix: DataFrame, tiling: Tiling) -> Preconditioner:
    """The blocks of the tiles of a matrix, each inverted once in a task, as a preconditioner."""
    tile = tiling.tile
    own = matrix.where(tile(F.col("src")) == tile(F.col("dst"))).withColumn("tile", tile(F.col("src")))
    blocks = materialize(own.groupBy("tile").applyInPandas(_packed_block, "of_tile long, ids array<long>, inverse binary"), "blocks")

    def divided(residuals: DataFrame, parts: int) -> DataFrame:
        dealt = residuals.select("rhs", "id", "r", tile(F.col("id")).alias("tile"), F.pmod(F.xxhash64("rhs"), F.lit(parts)).cast("int").alias("part"))
        sent = blocks.withColumn("of_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return dealt.groupBy("tile", "part").cogroup(sent.groupBy("of_tile", "of_part")).applyInPandas(lambda r, m: _divide(r, m), "rhs long, id long, z double")

    return divided


def conjugate_gradient(matrix: DataFrame, rhs: DataFrame, rtol: float = 1e-6, maxiter: int = 100_000, tiling: Tiling | None = None, preconditioner: Preconditioner | None = None) -> DataFrame:
    """Solve a positive definite system for all right-hand sides (id, rhs, value) at once.

    Preconditioned by ``preconditioner``, a function of a table (rhs, id, r) and a number of parts of the right-hand sides that
    gives (rhs, id, z), as ``multigrid.multigrid`` makes one; by default by the blocks of the ``tiling``, inverted once.
    The vectors of all right-hand sides are one table keyed by (rhs, id); a round is one join with the matrix and sums by
    ``rhs``.  The number of right-hand sides not yet solved is all the driver sees.  Raises ``RuntimeError`` if ``maxiter``
    rounds do not do; ``ValueError`` for a negative ``rtol``.
    """
    if rtol < 0 or maxiter < 1:
        raise ValueError("rtol must not be negative, maxiter at least 1")
    matrix = materialize(matrix.select("src", "dst", "weight"), "cg-matrix")
    entries = matrix.select(F.col("src").alias("id"), F.col("dst").alias("from"), "weight")
    wanted = materialize(rhs.select("rhs").distinct(), "cg-sides")
    parts = -(-wanted.count() // SIDES) or 1
    divide = preconditioner or block_inverses(matrix, tiling or Tiling(TILE_SIDE))

    def divided(table: DataFrame) -> DataFrame:
        return table.join(divide(table, parts), ["rhs", "id"])

    # every right-hand side has a value for every unknown: that is the size of the solution
    start = wanted.crossJoin(matrix.where("src = dst").select(F.col("src").alias("id")).distinct())
    state = start.join(rhs, ["rhs", "id"], "left").select("rhs", "id", F.coalesce("value", F.lit(0.0)).alias("r"), F.lit(0.0).alias("x"))
    state = materialize(divided(materialize(state, "cg")).withColumn("p", F.col("z")), "cg")
    goal = materialize(state.groupBy("rhs").agg(F.sum(F.col("r") * F.col("r")).alias("goal")), "cg")
    for _ in range(maxiter):
        norms = state.groupBy("rhs").agg(F.sum(F.col("r") * F.col("r")).alias("rr"))
        if norms.join(goal, "rhs").where(F.col("rr") > F.col("goal") * rtol * rtol).isEmpty():
            return state.select("id", "rhs", F.col("x").alias("value"))
        ap = state.select("rhs", F.col("id").alias("from"), "p").join(entries, "from").groupBy("rhs", "id").agg(F.sum(F.col("weight") * F.col("p")).alias("ap"))
        joined = materialize(state.join(ap, ["rhs", "id"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0))), "cg")
        scale = joined.groupBy("rhs").agg(F.sum(F.col("r") * F.col("z")).alias("rz"), F.sum(F.col("p") * F.col("ap")).alias("pap"))
        alpha = F.when(F.col("pap") > 0, F.col("rz") / F.col("pap")).otherwise(0.0)
        moved = joined.join(scale, "rhs").select("rhs", "id", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p", "rz")
        moved = materialize(divided(materialize(moved, "cg")), "cg-round")
        beta = moved.groupBy("rhs").agg(F.sum(F.col("r") * F.col("z")).alias("rz2"), F.max("rz").alias("rz1"))
        beta = beta.select("rhs", F.when(F.col("rz1") > 0, F.col("rz2") / F.col("rz1")).otherwise(0.0).alias("beta"))
        state = moved.join(beta, "rhs").withColumn("p", F.col("z") + F.col("beta") * F.col("p")).select("rhs", "id", "r", "x", "z", "p")
    raise RuntimeError(f"not solved to {rtol} in {maxiter} rounds")


def dense_solve(matrix: DataFrame, rhs: DataFrame) -> DataFrame:
    """The same by one dense factorisation in a task, for up to ``DENSE_LIMIT`` unknowns."""
    size = matrix.select("src").distinct().count()
    if size > DENSE_LIMIT:
        raise ValueError(f"{size} unknowns; a dense solve takes {DENSE_LIMIT} at most")

    def run(key, m: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, columns = np.unique(m["src"]), np.unique(b["rhs"])
        a, y = np.zeros((len(ids), len(ids))), np.zeros((len(ids), len(columns)))
        np.add.at(a, (np.searchsorted(ids, m["src"]), np.searchsorted(ids, m["dst"])), m["weight"])
        np.add.at(y, (np.searchsorted(ids, b["id"]), np.searchsorted(columns, b["rhs"])), b["value"])
        x = np.linalg.solve(a, y)
        return pd.DataFrame({"id": np.repeat(ids, len(columns)), "rhs": np.tile(columns, len(ids)), "value": x.ravel()})

    left, right = (t.withColumn("one", F.lit(0)) for t in (matrix, rhs))
    return left.groupBy("one").cogroup(right.groupBy("one")).applyInPandas(run, "id long, rhs long, value double")


def linear_solve(matrix: DataFrame, rhs: DataFrame, solver: str | Solver = "auto", rtol: float = 1e-6, maxiter: int = 100_000, tiling: Tiling | None = None) -> DataFrame:
    """(id, [rhs,] value) with matrix x = rhs.

    ``solver`` is "cg" (conjugate gradients, preconditioned by blocks of ``tiling``), "amg" (by multigrid), "direct" (nested
    dissection of ``tiling``), "dense", "auto" (dense or cg, by size), or a function of the matrix and the right-hand sides.
    """
    one = "rhs" not in rhs.columns
    many = rhs.withColumn("rhs", F.lit(0).cast("long")) if one else rhs
    if solver == "auto":
        solver = "dense" if matrix.select("src").distinct().count() <= DENSE_LIMIT else "cg"
    if callable(solver):
        out = solver(matrix, many).select("id", "rhs", "value")
    elif solver == "direct":
        out = factorize(matrix, tiling).solve(many)
    elif solver == "dense":
        out = dense_solve(matrix, many)
    elif solver in ("cg", "amg"):
        out = conjugate_gradient(matrix, many, rtol, maxiter, tiling, multigrid(matrix) if solver == "amg" else None)
    else:
        raise ValueError("solver is one of auto, cg, amg, direct, dense, or a function")
    return out.drop("rhs") if one else out
