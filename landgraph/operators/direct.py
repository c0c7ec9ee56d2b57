"""A sparse direct solver by nested dissection: elimination over a tree of tiles.

A vertex is eliminated in the smallest tile that holds all of its neighbours, so what a tile cannot eliminate is its
rim.  Level by level, from small tiles to large, a task for each tile adds up the matrix entries of the vertices
that it eliminates and what the tiles below passed on, eliminates, and passes on the Schur complement of its rim.  Each tile's
part of the factor is a row of a table; it is worked out once, and any right-hand sides are solved with it by one pass up
the tree and one down.  No task sees more than a front, a tile's own vertices and rim: on a raster of n cells the largest
has some 4 sqrt(n) vertices, and the factor grows with n log n.

The matrix need not be symmetric, and is divided by without pivots outside of a front: it should be positive definite
(which is checked if it is said to be) or dominated by its diagonal.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .tiles import Tiling

#: The side of the smallest tiles, vertices of a front at most, right-hand sides that are solved together.
SIDE, FRONT, SIDES = 8, 16_000, 512
_FRONT = "tile long, own array<long>, rim array<long>, rim_level array<int>, inverse binary, down binary, up binary, schur binary"
_VALUES = "id long, rhs long, value double, level int"


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(rows, -1) if rows else np.zeros((0, 0))


def _front(level: int, definite: bool, most: int, entries: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
    """Eliminate what belongs to a tile, given its ``entries`` (tile, src, dst, weight, src_level, dst_level) and the
    fronts ``below`` (tile, rim, rim_level, schur)."""
    tile = int((entries if len(entries) else below)["tile"].iloc[0])
    ids = [entries["src"].to_numpy(), entries["dst"].to_numpy(), *(np.asarray(r) for r in below["rim"])]
    levels = [entries["src_level"].to_numpy(), entries["dst_level"].to_numpy(), *(np.asarray(r) for r in below["rim_level"])]
    ids, first = np.unique(np.concatenate(ids).astype(np.int64), return_index=True)
    levels = np.concatenate(levels)[first]
    if len(ids) > most:
        raise ValueError(f"a front of {len(ids)} vertices; {most} at most: use another solver, or tiles that cut the graph better")
    order = np.argsort(levels > level, kind="stable")  # its own first
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    a = np.zeros((len(ids), len(ids)))
    at = lambda x: place[np.searchsorted(ids, x)]
    np.add.at(a, (at(entries["src"]), at(entries["dst"])), entries["weight"].to_numpy())
    for rim, schur in zip(below["rim"], below["schur"], strict=True):
        k = at(np.asarray(rim))
        a[np.ix_(k, k)] += _matrix(schur, len(k))
    n = int((levels <= level).sum())
    ids, levels = ids[order], levels[order]
    try:
        if definite:
            np.linalg.cholesky(a[:n, :n])
        inverse = np.linalg.inv(a[:n, :n])
    except np.linalg.LinAlgError as e:
        raise ValueError("the matrix is not positive definite" if definite else "the matrix is singular") from e
    down, up = inverse @ a[:n, n:], a[n:, :n] @ inverse
    schur = a[n:, n:] - a[n:, :n] @ down
    row = {"tile": tile, "own": ids[:n], "rim": ids[n:], "rim_level": levels[n:].astype(np.int32)}
    row |= {"inverse": inverse.tobytes(), "down": down.tobytes(), "up": up.tobytes(), "schur": schur.tobytes()}
    return pd.DataFrame({k: [v] for k, v in row.items()})


def _gathered(values: pd.DataFrame, ids: np.ndarray, sides: np.ndarray) -> np.ndarray:
    out = np.zeros((len(ids), len(sides)))
    order = np.argsort(ids)
    at = order[np.searchsorted(ids, values["id"], sorter=order)] if len(values) else np.zeros(0, dtype=int)
    np.add.at(out, (at, np.searchsorted(sides, values["rhs"])), values["value"].to_numpy())
    return out


def _spread(ids: np.ndarray, sides: np.ndarray, values: np.ndarray, level) -> pd.DataFrame:
    return pd.DataFrame({"id": np.repeat(ids, len(sides)), "rhs": np.tile(sides, len(ids)), "value": values.ravel(), "level": np.repeat(level, len(sides))})


_NOTHING = pd.DataFrame({"id": [], "rhs": [], "value": [], "level": []}).astype({"id": "int64", "rhs": "int64", "level": "int32"})


def _go_up(values: pd.DataFrame, fronts: pd.DataFrame) -> pd.DataFrame:
    """From the right-hand sides (id, rhs, value) of a front's own vertices: these (level -1), and what its rim's change by."""
    if not len(values) or not len(fronts):
        return _NOTHING
    f, sides = fronts.iloc[0], np.unique(values["rhs"])
    own, rim = np.asarray(f["own"]), np.asarray(f["rim"], dtype=np.int64)
    r = _gathered(values, own, sides)
    parts = [_spread(own, sides, r, np.full(len(own), -1))]
    if len(rim):
        parts.append(_spread(rim, sides, -_matrix(f["up"], len(rim)) @ r, np.asarray(f["rim_level"])))
    return pd.concat(parts)


def _go_down(values: pd.DataFrame, fronts: pd.DataFrame) -> pd.DataFrame:
    """From what ``_go_up`` kept of a front (is_rim false), and the solution on its rim: that of its own vertices."""
    if not len(values) or not len(fronts):
        return _NOTHING
    f, sides, on_rim = fronts.iloc[0], np.unique(values["rhs"]), values["is_rim"].to_numpy(dtype=bool)
    own, rim = np.asarray(f["own"]), np.asarray(f["rim"], dtype=np.int64)
    x = _matrix(f["inverse"], len(own)) @ _gathered(values[~on_rim], own, sides)
    if len(rim):
        x -= _matrix(f["down"], len(own)) @ _gathered(values[on_rim], rim, sides)
    return _spread(own, sides, x, np.zeros(len(own)))


@dataclass
class Factor:
    """A factorised matrix; ``solve`` as often as wanted."""

    tiling: Tiling
    nodes: DataFrame
    fronts: list[DataFrame] = field(default_factory=list)

    def _met(self, values: DataFrame, level: int, step, parts: int, *more: str) -> DataFrame:
        """``step`` for each front of a level and part of the right-hand sides."""
        part = F.pmod(F.xxhash64("rhs"), F.lit(parts)).cast("int").alias("part")
        dealt = values.select("tile", part, "id", "rhs", "value", *more)
        fronts = self.fronts[level].drop("schur").withColumnRenamed("tile", "of_tile")
        fronts = dealt.select("tile", "part").distinct().toDF("to_tile", "to_part").join(fronts, F.col("to_tile") == F.col("of_tile"))
        return dealt.groupBy("tile", "part").cogroup(fronts.groupBy("to_tile", "to_part")).applyInPandas(lambda v, f: step(v, f), _VALUES)

    def solve(self, rhs: DataFrame) -> DataFrame:
        """(id, rhs, value) for all unknowns and right-hand sides of ``rhs`` (id, rhs, value; others are 0)."""
        sides = materialize(rhs.select("rhs").distinct(), "sides")
        parts = -(-sides.count() // SIDES) or 1
        of_level = lambda n: self.tiling.tile(F.col("id"), n)
        given = materialize(rhs.select("id", "rhs", "value").join(self.nodes.select("id", "level"), "id"), "given")
        steps: list[DataFrame] = []
        for n in range(len(self.fronts)):
            now = given.where(F.col("level") == n).select("id", "rhs", "value")
            for s in steps:
                now = now.unionByName(s.where(F.col("level") == n).select("id", "rhs", "value"))
            steps.append(materialize(self._met(now.withColumn("tile", of_level(n)), n, _go_up, parts), "up"))
        solved: DataFrame | None = None
        for n in reversed(range(len(self.fronts))):
            kept = steps[n].where("level = -1").select(of_level(n).alias("tile"), "id", "rhs", "value", F.lit(False).alias("is_rim"))
            if solved is not None:
                rims = self.fronts[n].select("tile", F.explode("rim").alias("id"))
                kept = kept.unionByName(rims.join(solved, "id").select("tile", "id", "rhs", "value", F.lit(True).alias("is_rim")))
            x = materialize(self._met(kept, n, _go_down, parts, "is_rim").select("id", "rhs", "value"), "down")
            solved = x if solved is None else solved.unionByName(x)
        if solved is None:
            return rhs.select("id", "rhs", "value").limit(0)
        # every right-hand side has a value for every unknown: that is the size of the solution
        whole = self.nodes.select("id").crossJoin(sides)
        return whole.join(solved, ["id", "rhs"], "left").select("id", "rhs", F.coalesce("value", F.lit(0.0)).alias("value"))


def factorize(matrix: DataFrame, tiling: Tiling | None = None, definite: bool = True) -> Factor:
    """Factorise a matrix (src, dst, weight), entry by entry of which both ends are unknowns.

    Entries of one place add up.  Raises ``ValueError`` where it is ``definite`` but turns out not to be, or is singular.
    """
    tiling = tiling or Tiling(SIDE)
    src, dst = F.col("src"), F.col("dst")
    entries = materialize(matrix.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "entries")
    met = entries.select(F.explode(F.array("src", "dst")).alias("id"), tiling.meeting(src, dst).alias("level"))
    nodes = materialize(met.groupBy("id").agg(F.max("level").alias("level")), "nodes")
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("level").alias(f"{s}_level"))
    level = F.least("src_level", "dst_level")
    first: Column = F.when(F.col("src_level") <= F.col("dst_level"), src).otherwise(dst)
    placed = entries.join(side("src"), "src").join(side("dst"), "dst").withColumn("level", level)
    placed = materialize(placed.withColumn("tile", tiling.tile(first, F.col("level"))), "placed")
    factor = Factor(tiling, nodes)
    top = nodes.agg(F.max("level")).first()[0]
    for n in range(0 if top is None else top + 1):
        own = placed.where(F.col("level") == n).select("tile", "src", "dst", "weight", "src_level", "dst_level")
        below = factor.nodes.sparkSession.createDataFrame([], "tile long, rim array<long>, rim_level array<int>, schur binary")
        for f in factor.fronts:
            up = f.where((F.size("rim") > 0) & (F.array_min("rim_level") == n))
            below = below.unionByName(up.select(tiling.tile(F.get("rim", F.lit(0)), n).alias("tile"), "rim", "rim_level", "schur"))
        both = own.groupBy("tile").cogroup(below.groupBy("tile"))
        factor.fronts.append(materialize(both.applyInPandas(partial(_front, n, definite, FRONT), _FRONT), "fronts"))
    return factor
