"""Shortest paths over a graph of tile borders.

A path that leaves a tile does so over its border, the vertices with an edge from or to another tile.  So the costs
between all border vertices of a tile are worked out once, and the search then hops from border to border: in
a round, every tile that was reached by a shorter path settles its border by one min-plus product and sends on what
leaves it.  Rounds grow with the tiles that a path crosses, and only labels of borders take part in them.  At last
one pass inwards, over the tiles that are asked for alone, gives the distances of all their vertices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, materialize_at
from .tiles import Tiling

#: Sources that are searched from together; rounds whose labels are read one by one before they are brought together.
SOURCE_PART, LOGS = 256, 24
_LABEL = "src long, dst long, distance double"


def relax(known: np.ndarray, tail: np.ndarray, head: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Lower ``known`` (vertices x sources; inf for none), in place, by all paths over the edges.

    An edge is followed again only while its tail became shorter for some source.
    """
    if not len(tail):
        return known
    order = np.argsort(head, kind="stable")
    tail, head, cost = tail[order], head[order], cost[order, None]
    fresh = np.isfinite(known).any(axis=1)
    while True:
        use = np.flatnonzero(fresh[tail])
        if not len(use):
            return known
        to = head[use]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        came = np.minimum.reduceat(known[tail[use]] + cost[use], first, axis=0)
        to = to[first]
        shorter = (came < known[to]).any(axis=1)
        fresh[:] = False
        fresh[to[shorter]] = True
        known[to[shorter]] = np.minimum(known[to[shorter]], came[shorter])


def _border(edges: pd.DataFrame, limit: float) -> pd.DataFrame:
    """One row for a tile, from its edges (tile, src, dst, cost, tail_tile, head_tile) within, out of and into it."""
    tile = int(edges["tile"].iloc[0])
    src, dst, cost = (edges[c].to_numpy() for c in ("src", "dst", "cost"))
    out, into = edges["head_tile"].to_numpy() != tile, edges["tail_tile"].to_numpy() != tile
    border = np.unique(np.concatenate([src[out], dst[into]]))
    inner = ~out & ~into
    names = np.unique(np.concatenate([border, src[inner], dst[inner]]))
    reach = np.full((len(names), len(border)), np.inf)
    at = np.searchsorted(names, border)
    reach[at, np.arange(len(border))] = 0.0
    relax(reach, np.searchsorted(names, src[inner]), np.searchsorted(names, dst[inner]), cost[inner])
    between = reach[at].T.copy()  # from, to
    between[between > limit] = np.inf
    row = {"tile": tile, "border": border, "between": between.tobytes(), "tail": np.searchsorted(border, src[out]), "head": dst[out], "cost": cost[out], "head_tile": edges["head_tile"].to_numpy()[out]}
    return pd.DataFrame({k: [v] for k, v in row.items()})


def _hop(labels: pd.DataFrame, tiles: pd.DataFrame, limit: float) -> pd.DataFrame:
    """What a tile's new labels (src, dst, distance, new) change: its own border labels that became shorter, and
    what these propose to the border vertices of other tiles."""
    names = ["src", "dst", "distance", "tile", "inside"]
    if not len(labels) or not len(tiles):
        return pd.DataFrame({c: [] for c in names}).astype({"src": "int64", "dst": "int64", "tile": "int64", "inside": bool})
    tile = tiles.iloc[0]
    border, sources = np.asarray(tile["border"]), np.unique(labels["src"])
    between = np.frombuffer(tile["between"]).reshape(len(border), len(border))
    was, now = (np.full((len(sources), len(border)), np.inf) for _ in range(2))
    s, b = np.searchsorted(sources, labels["src"]), np.searchsorted(border, labels["dst"])
    new, d = labels["new"].to_numpy(), labels["distance"].to_numpy()
    np.minimum.at(was, (s[~new], b[~new]), d[~new])
    np.minimum.at(now, (s[new], b[new]), d[new])
    now[now >= was] = np.inf
    came = np.minimum(was, now)
    for k in np.flatnonzero(np.isfinite(now).any(axis=0)):
        np.minimum(came, now[:, k, None] + between[k], out=came)
    came[came > limit] = np.inf
    i, j = np.nonzero(came < was)
    inside = pd.DataFrame({"src": sources[i], "dst": border[j], "distance": came[i, j], "tile": int(tile["tile"]), "inside": True})
    tail, head, cost, to = (np.asarray(tile[c]) for c in ("tail", "head", "cost", "head_tile"))
    moved = (came < was)[:, tail] & (came[:, tail] + cost <= limit) if len(tail) else np.zeros((len(sources), 0), dtype=bool)
    i, j = np.nonzero(moved)
    away = pd.DataFrame({"src": sources[i], "dst": head[j], "distance": came[i, tail[j]] + cost[j], "tile": to[j], "inside": False})
    away = away.groupby(["src", "dst", "tile", "inside"], as_index=False)["distance"].min()
    return pd.concat([inside, away])[names]


def _inwards(labels: pd.DataFrame, edges: pd.DataFrame, limit: float) -> pd.DataFrame:
    """(src, dst, distance) of all vertices of a tile, from labels of some and the edges (src, dst, cost) within it."""
    if not len(labels):
        return pd.DataFrame({"src": [], "dst": [], "distance": []}).astype({"src": "int64", "dst": "int64"})
    names, sources = np.unique(np.concatenate([labels["dst"], edges["src"], edges["dst"]])), np.unique(labels["src"])
    known = np.full((len(names), len(sources)), np.inf)
    np.minimum.at(known, (np.searchsorted(names, labels["dst"]), np.searchsorted(sources, labels["src"])), labels["distance"].to_numpy())
    relax(known, np.searchsorted(names, edges["src"]), np.searchsorted(names, edges["dst"]), edges["cost"].to_numpy())
    i, j = np.nonzero(np.isfinite(known) & (known <= limit))
    return pd.DataFrame({"src": sources[j], "dst": names[i], "distance": known[i, j]})


def border_search(edges: DataFrame, sources: DataFrame, tiling: Tiling, targets: DataFrame | None = None, max_distance: float | None = None, max_rounds: int = 1_000_000) -> DataFrame:
    """(src, dst, distance) of the shortest paths from all ``sources`` (id) to all vertices, or those of ``targets`` (id).

    An edge costs the reciprocal of its weight.  Distances above ``max_distance`` are left out, and not searched beyond.
    """
    spark, limit = edges.sparkSession, float("inf") if max_distance is None else float(max_distance)
    tile = tiling.tile
    costs = edges.select("src", "dst", (1.0 / F.col("weight")).alias("cost"), tile(F.col("src")).alias("tail_tile"), tile(F.col("dst")).alias("head_tile"))
    costs = materialize(costs, "costs")
    sides = F.explode(F.array_distinct(F.array("tail_tile", "head_tile"))).alias("tile")
    schema = "tile long, border array<long>, between binary, tail array<long>, head array<long>, cost array<double>, head_tile array<long>"
    tiles = costs.select(sides, "*").groupBy("tile").applyInPandas(lambda pdf: _border(pdf, limit), schema)
    tiles = materialize(tiles.where(F.size("border") > 0), "tiles")
    inner = costs.where("tail_tile = head_tile").select(F.col("tail_tile").alias("of_tile"), "src", "dst", "cost")

    start = materialize(sources.select("id").distinct().select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("distance"), tile(F.col("id")).alias("tile")), "sources")
    parts = -(-start.count() // SOURCE_PART) or 1
    part = F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int").alias("part")

    def inwards(labels: DataFrame) -> DataFrame:
        dealt = labels.select("src", "dst", "distance", "tile", part)
        local = dealt.select("tile", "part").distinct().toDF("to_tile", "to_part").join(inner, F.col("to_tile") == F.col("of_tile"))
        both = dealt.groupBy("tile", "part").cogroup(local.select("to_tile", "to_part", "src", "dst", "cost").groupBy("to_tile", "to_part"))
        return both.applyInPandas(lambda a, b: _inwards(a, b, limit), _LABEL)

    ends = tiles.select("tile", F.explode("border").alias("dst"))
    frontier = inwards(start).join(ends, "dst").select("src", "dst", "distance", "tile", F.lit(False).alias("inside"))
    frontier, _ = materialize_at(frontier, "border-start")
    logs: list[str] = []
    read = lambda: spark.read.schema(frontier.schema).parquet(*logs).where("inside")
    for n in range(max_rounds):
        if frontier.isEmpty():
            break
        active = frontier.select("tile").distinct()
        labels = frontier.withColumn("new", F.lit(True))
        if logs:
            labels = labels.unionByName(read().join(active, "tile", "left_semi").withColumn("new", F.lit(False)))
        labels = labels.select("src", "dst", "distance", "tile", part, "new")
        local = labels.select("tile", "part").distinct().toDF("to_tile", "to_part").join(tiles, F.col("to_tile") == F.col("tile"))
        both = labels.groupBy("tile", "part").cogroup(local.groupBy("to_tile", "to_part"))
        moved, path = materialize_at(both.applyInPandas(lambda a, b: _hop(a, b, limit), f"{_LABEL}, tile long, inside boolean"), "border-round")
        logs.append(path)
        frontier = moved.where("not inside").groupBy("src", "dst", "tile", "inside").agg(F.min("distance").alias("distance")).select(*frontier.columns)
        if len(logs) > LOGS:
            least = read().groupBy("src", "dst", "tile", "inside").agg(F.min("distance").alias("distance")).select(*frontier.columns)
            logs = [materialize_at(least, "border-labels")[1]]
    else:
        raise RuntimeError(f"distances still change after {max_rounds} rounds")
    labels = start.unionByName(read().drop("inside")) if logs else start
    if targets is None:
        return inwards(labels)
    wanted = materialize(targets.select(F.col("id").alias("dst")).distinct(), "targets")
    held = labels.join(wanted.select(tile(F.col("dst")).alias("tile")).distinct(), "tile", "left_semi")
    return inwards(held).join(wanted, "dst", "left_semi").select("src", "dst", "distance")
