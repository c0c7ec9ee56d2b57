"""Shortest paths of all pairs by blocks of the distance matrix, one pivot block a round.

In round k the pivot block is closed by itself, then the blocks of its row and column are lowered by paths through it, and then
all others by what meets in a row and a column block (two equi-joins).  A task holds three blocks; there is no bound on the
number of vertices but that of the result, n^2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

BLOCK = 256
_BLOCKS = "i long, j long, d binary"


def _square(raw: bytes) -> np.ndarray:
    d = np.frombuffer(raw)
    return d.reshape(int(round(len(d) ** 0.5)), -1).copy()


def closed(d: np.ndarray) -> np.ndarray:
    """Lower ``d`` by all paths between its own vertices."""
    for k in range(len(d)):
        np.minimum(d, d[:, k, None] + d[k], out=d)
    return d


def through(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower ``d`` by the paths that go by way of ``a`` and then ``b``."""
    for k in np.flatnonzero(np.isfinite(a).any(axis=0) & np.isfinite(b).any(axis=1)):
        np.minimum(d, a[:, k, None] + b[k], out=d)
    return d


def _first(block: int, zero: bool, place: tuple, _: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    d = np.full((block, block), np.inf)
    np.minimum.at(d, (edges["src"].to_numpy() % block, edges["dst"].to_numpy() % block), edges["cost"].to_numpy())
    if zero and place[0] == place[1]:
        np.fill_diagonal(d, 0.0)
    return pd.DataFrame({"i": [place[0]], "j": [place[1]], "d": [d.tobytes()]})


def all_pairs(edges: DataFrame, nv: int, roundtrip: bool = False, block: int = BLOCK) -> DataFrame:
    """(i, j, d): the blocks of the distances between vertices 0 to nv - 1, from edges (src, dst, weight) that cost 1 / weight.

    d(v, v) is 0, or with ``roundtrip`` the cheapest way back.
    """
    spark, count = edges.sparkSession, -(-nv // block)
    places = spark.range(count * count).select(F.floor(F.col("id") / count).alias("i"), F.pmod("id", F.lit(count)).alias("j"))
    costs = edges.select(F.floor(F.col("src") / block).alias("ei"), F.floor(F.col("dst") / block).alias("ej"), "src", "dst", (1.0 / F.col("weight")).alias("cost"))

    def first(place: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _first(block, not roundtrip, place, a, b)

    now = materialize(places.groupBy("i", "j").cogroup(costs.groupBy("ei", "ej")).applyInPandas(first, _BLOCKS), "blocks")
    for k in range(count):

        def pivot(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in rows:
                yield t.assign(d=[closed(_square(d)).tobytes() for d in t["d"]])

        def panel(rows: Iterator[pd.DataFrame], k: int = k) -> Iterator[pd.DataFrame]:
            for t in rows:
                out = []
                for i, d, p in zip(t["i"], t["d"], t["p"], strict=True):
                    own, mid = _square(d), _square(p)
                    out.append((through(own.copy(), mid, own) if i == k else through(own.copy(), own, mid)).tobytes())
                yield t[["i", "j"]].assign(d=out)

        def rest(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in rows:
                yield t[["i", "j"]].assign(d=[through(_square(d), _square(a), _square(b)).tobytes() for d, a, b in zip(t["d"], t["a"], t["b"], strict=True)])

        here = (F.col("i") == k).cast("int") + (F.col("j") == k).cast("int")
        mid = materialize(now.where(here == 2).mapInPandas(pivot, _BLOCKS), "pivot")  # one block
        sides = now.where(here == 1).crossJoin(F.broadcast(mid.select(F.col("d").alias("p")))).mapInPandas(panel, _BLOCKS)
        if count == 1:
            return mid
        sides = materialize(sides.repartition(count), "panels")
        column, row = sides.where(F.col("j") == k).select("i", F.col("d").alias("a")), sides.where(F.col("i") == k).select("j", F.col("d").alias("b"))
        others = now.where(here == 0).join(column, "i").join(row, "j").select("i", "j", "d", "a", "b").repartition(min(2_000, count * count))
        now = materialize(others.mapInPandas(rest, _BLOCKS).unionByName(sides).unionByName(mid), "blocks")
    return now


def pairs(blocks: DataFrame, nv: int) -> DataFrame:
    """(src, dst, distance) of the finite entries of blocks, between vertices 0 to nv - 1."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in rows:
            for i, j, d in zip(t["i"], t["j"], t["d"], strict=True):
                x = _square(d)
                a, b = np.nonzero(np.isfinite(x))
                a, b, d = i * len(x) + a, j * len(x) + b, x[a, b]
                real = (a < nv) & (b < nv)
                yield pd.DataFrame({"src": a[real], "dst": b[real], "distance": d[real]})

    return blocks.mapInPandas(run, "src long, dst long, distance double")
