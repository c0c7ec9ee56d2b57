"""Distances between vertices of a graph: Euclidean, least-cost path, resistance, randomised paths.

Every metric is called as ``metric(graph, sources, targets)`` or ``metric(graph, nodes=...)`` and
returns (src, dst, distance); a pair that is not connected has no row.  Vertices are ids, (row, col)
pairs, or tables with ``id`` or ``row`` and ``col``; a missing side means all vertices.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..graph import GridGraph
from ..raster import vertex
from . import algebra
from .allpairs import BLOCK, all_pairs, pairs
from .borders import border_search
from .direct import SIDE as FRONT_SIDE
from .direct import factorize
from .solve import TILE_SIDE as BLOCK_SIDE
from .solve import Solver, linear_solve
from .store import materialize
from .tiles import Tiling

Adjoint = Callable[[np.ndarray], np.ndarray]
#: Edges of a graph that is broadcast to the tasks of a kernel; beyond it, joins are used.
KERNEL_EDGES, DENSE_VERTICES = 200_000, 2_500
#: Beyond it, vertices of a tile that is searched at once.
TILE_VERTICES = 2_304
#: Products of a squaring of the matrix of walks, beyond which walks go on by the steps at hand; squarings without convergence.
WALK_PRODUCTS, WALK_DOUBLINGS = 5_000_000, 64
_RESULT = "src long, dst long, distance double"


def vertices(graph, given) -> DataFrame | None:
    """The table (id) of what was given, or None."""
    if given is None:
        return None
    spark = graph.edges().sparkSession
    if not isinstance(given, DataFrame):
        given = list(given) if isinstance(given, (Sequence, np.ndarray)) else [given]
        if given and isinstance(given[0], (Sequence, np.ndarray)):
            given = spark.createDataFrame([(int(a), int(b)) for a, b in given], "row int, col int")
        else:
            given = spark.createDataFrame([(int(v),) for v in given], "id long")
    if "id" in given.columns:
        return given.select(F.col("id").cast("long").alias("id"))
    if not isinstance(graph, GridGraph):
        raise ValueError("coordinates need a grid graph")
    return given.select(vertex(F.col("row"), F.col("col"), graph.width).alias("id"))


class Distance(ABC):
    """Dispatches the call forms; a metric says how sources reach targets (None: all vertices)."""

    def __call__(self, graph, sources=None, targets=None, nodes=None) -> DataFrame:
        if nodes is not None:
            if sources is not None or targets is not None:
                raise ValueError("give nodes, or sources and targets, not both")
            nodes = vertices(graph, nodes)
            return self.between(graph, nodes, nodes)
        return self.between(graph, vertices(graph, sources), vertices(graph, targets))

    @abstractmethod
    def between(self, graph, sources: DataFrame | None, targets: DataFrame | None) -> DataFrame:
        """(src, dst, distance) of all sources and targets, tables of ``id``."""

    def in_windows(self, p: np.ndarray) -> tuple[np.ndarray, Adjoint]:
        """For windowed analyses: distances from the centre of each window of the permeabilities ``p`` (windows, rows,
        columns) to its cells (inf: none), and the adjoint: from the gradient by distances to that by permeabilities."""
        raise ValueError(f"{self} has no kernel for windows: it does not define in_windows")


def _everyone(graph) -> DataFrame:
    return graph.edges().sparkSession.range(graph.nv).select("id")


def _only(found: DataFrame, targets: DataFrame | None) -> DataFrame:
    return found if targets is None else found.join(targets.distinct().withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "distance")


def _collected(graph) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The edges, if they are few enough to go to every task."""
    rows = graph.edges().limit(KERNEL_EDGES + 1).toPandas()
    return None if len(rows) > KERNEL_EDGES else (rows["src"].to_numpy(), rows["dst"].to_numpy(), rows["weight"].to_numpy())


@dataclass(frozen=True)
class EuclideanDistance(Distance):
    """Straight lines between cells; permeability plays no part."""

    def between(self, graph, sources, targets):
        if not isinstance(graph, GridGraph):
            raise ValueError("Euclidean distances need a grid graph")
        sides = []
        for name, side in (("src", sources), ("dst", targets)):
            side = _everyone(graph) if side is None else side.distinct()
            sides.append(side.select(F.col("id").alias(name), F.floor(F.col("id") / graph.width).alias(f"{name}_r"), F.pmod("id", F.lit(graph.width)).alias(f"{name}_c")))
        both = sides[0].crossJoin(sides[1])  # the full table is what was asked for; see ``euclidean_within``
        return both.select("src", "dst", F.hypot(F.col("src_r") - F.col("dst_r"), F.col("src_c") - F.col("dst_c")).alias("distance"))

    def in_windows(self, p):
        _, h, w = p.shape
        d = np.hypot(np.arange(h)[:, None] - h // 2, np.arange(w)[None, :] - w // 2)
        return np.broadcast_to(d, p.shape), np.zeros_like


def euclidean_within(cells: DataFrame, limit: int, width: int) -> DataFrame:
    """Pairs of cells (row, col) less than ``limit`` apart, by a join of bins instead of all pairs."""
    binned = lambda c: F.floor(F.col(c) / limit).cast("int")
    a = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), binned("row").alias("br"), binned("col").alias("bc"))
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = a.select(F.col("r").alias("r2"), F.col("c").alias("c2"), "br", "bc", F.explode(near).alias("o"))
    b = b.select("r2", "c2", (F.col("br") + F.col("o.i")).alias("br"), (F.col("bc") + F.col("o.j")).alias("bc"))
    d = F.hypot(F.col("r") - F.col("r2"), F.col("c") - F.col("c2"))
    return a.join(b, ["br", "bc"]).where(d < limit).select(vertex(F.col("r"), F.col("c"), width).alias("src"), vertex(F.col("r2"), F.col("c2"), width).alias("dst"), d.alias("distance"))


@dataclass(frozen=True)
class LCPDistance(Distance):
    """Least-cost paths; an edge costs the reciprocal of its weight.

    ``bellman-ford`` searches from the sources only: in the tasks over a broadcast graph if that is
    small, else over the borders of tiles (of ``tile`` vertices each), and only in tiles that hold targets inside of them.  ``floyd-warshall`` does all pairs by
    blocks of the matrix; ``diagonal="roundtrip"`` gives the cheapest way back for d(i, i).
    """

    algorithm: str = "bellman-ford"
    diagonal: str = "zero"
    kernel: bool | None = None
    tile: int = TILE_VERTICES

    def __post_init__(self):
        if self.algorithm not in ("bellman-ford", "floyd-warshall"):
            raise ValueError("algorithm is bellman-ford or floyd-warshall")

    def between(self, graph, sources, targets):
        start = _everyone(graph) if sources is None else sources.distinct()
        if self.algorithm == "floyd-warshall":
            blocks = all_pairs(graph.edges(), graph.nv, self.diagonal == "roundtrip")
            if sources is None:
                return _only(pairs(blocks, graph.nv), targets)
            blocks = blocks.join(start.select(F.floor(F.col("id") / BLOCK).alias("i")).distinct(), "i", "left_semi").select("i", "j", "d")
            return _only(pairs(blocks, graph.nv).join(start.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "distance"), targets)
        edges = None if self.kernel is False else _collected(graph)
        if edges is None:
            return frontier_search(graph.edges(), start, tile=self.tile, width=getattr(graph, "width", None), targets=targets)
        n = graph.nv

        def run(parts):
            paths = K.Paths(*edges, n)
            for part in parts:
                for s in part["id"]:
                    d = paths.distances(int(s))
                    at = np.flatnonzero(np.isfinite(d))
                    yield pd.DataFrame({"src": s, "dst": at, "distance": d[at]})

        return _only(start.repartition(_tasks(start)).mapInPandas(run, _RESULT), targets)

    def in_windows(self, p):
        d = K.window_lcp(p, p.shape[1] // 2, p.shape[2] // 2)
        return d, lambda g: K.window_lcp_adjoint(p, d, g)


def _tasks(df: DataFrame) -> int:
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64))


def frontier_search(edges: DataFrame, sources: DataFrame, max_distance: float | None = None, max_rounds: int = 1_000_000, tile: int = TILE_VERTICES, width: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Shortest paths from all sources at once over the borders of tiles of some ``tile`` vertices: square ones of a raster
    ``width`` wide, else of consecutive ids (``borders.border_search``)."""
    return border_search(edges, sources, Tiling(max(1, isqrt(tile)), width), targets, max_distance, max_rounds)


@dataclass(frozen=True)
class ResistanceDistance(Distance):
    """Effective resistance between vertices of an undirected graph.

    ``solver``: None is dense in one task; "cg", "amg" and "direct" (of square tiles of a raster), or a function as
    ``linear_solve`` takes one, solve one system for each vertex asked for; "auto" is dense for small graphs, else direct for
    rasters and cg for others.  An asymmetric graph raises ``ValueError``
    unless ``symmetrize``.  ``disconnected="pinv"`` gives finite values between components.
    """

    solver: str | Solver | None = None
    symmetrize: bool = False
    disconnected: str = "inf"
    rtol: float = 1e-9

    def between(self, graph, sources, targets):
        edges = graph.edges()
        both = edges.unionByName(algebra.transpose(edges)).groupBy("src", "dst").agg((F.sum("weight") / 2).alias("weight"), F.count(F.lit(1)).alias("n"), F.min("weight").alias("a"), F.max("weight").alias("b"))
        both = materialize(both.where("src <> dst"), "undirected")
        if not self.symmetrize and not both.where("n < 2 or abs(a - b) > 1e-9 * b").isEmpty():
            raise ValueError("resistance needs a symmetric graph; pass symmetrize=True for the mean of both directions")
        both = both.select("src", "dst", "weight")
        start = _everyone(graph) if sources is None else sources.distinct()
        solver = self.solver or "dense"
        if solver == "auto":
            solver = "dense" if graph.nv <= DENSE_VERTICES else "direct" if isinstance(graph, GridGraph) else "cg"
        if solver == "dense":
            if graph.nv > DENSE_VERTICES:
                raise ValueError(f"dense resistance is for up to {DENSE_VERTICES} vertices; use solver='cg'")
            return _only(self._dense(both, graph.nv, start), targets)
        if not callable(solver) and solver not in ("cg", "amg", "direct"):
            raise ValueError("solver is one of dense, cg, amg, direct, auto, or a function")
        return self._by_solves(both, graph, start, targets, solver)

    def _dense(self, edges, n, start):
        how, table = self.disconnected, edges.toPandas()
        src, dst, weight = (table[c].to_numpy() for c in ("src", "dst", "weight"))

        def run(parts):
            r = None
            for part in parts:
                r = K.resistance(K.dense(src, dst, weight, n), how) if r is None else r
                for s in part["id"]:
                    at = np.flatnonzero(np.isfinite(r[int(s)]))
                    yield pd.DataFrame({"src": s, "dst": at, "distance": np.where(at == int(s), 0.0, r[int(s)][at])})

        return start.coalesce(1).mapInPandas(run, _RESULT)

    def _by_solves(self, edges, graph, start, targets, solver):
        """Each component's greatest vertex is grounded; solutions for S and T give R = u_ii + u_jj - 2 u_ij."""
        labels = algebra.components(edges, _everyone(graph))
        ground = labels.groupBy("label").agg(F.max("id").alias("ground"))
        free = materialize(labels.join(ground, "label").where("id <> ground").select("id", "label"), "free")
        goal = _everyone(graph) if targets is None else targets.distinct()
        asked = materialize(start.unionByName(goal).distinct().join(labels, "id"), "asked")
        lap = materialize(algebra.submatrix(algebra.laplacian(edges), free, free), "grounded")
        basis = asked.join(free.select("id"), "id", "left_semi").select("id", F.col("id").alias("rhs"), F.lit(1.0).alias("value"))
        tiling = Tiling.of_graph(graph, FRONT_SIDE if solver == "direct" else BLOCK_SIDE)
        found = linear_solve(lap, basis, solver, self.rtol, tiling=tiling)
        u = materialize(found.join(asked.select("id"), "id", "left_semi"), "potentials")
        own = u.where("id = rhs").select("id", F.col("value").alias("own"))
        a = start.join(asked, "id").join(own, "id", "left").select(F.col("id").alias("src"), "label", F.coalesce("own", F.lit(0.0)).alias("a"))
        b = goal.join(asked, "id").join(own, "id", "left").select(F.col("id").alias("dst"), "label", F.coalesce("own", F.lit(0.0)).alias("b"))
        cross = u.select(F.col("id").alias("dst"), F.col("rhs").alias("src"), "value")
        pairs = a.join(b, "label").join(cross, ["src", "dst"], "left")
        return pairs.select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.col("a") + F.col("b") - 2 * F.coalesce("value", F.lit(0.0))).alias("distance"))

    def in_windows(self, p):
        _, h, w = p.shape
        parts = [K.window_resistance(x, h // 2 * w + w // 2) for x in p]
        adjoint = lambda g: np.array([K.window_resistance_adjoint(x, v, at, y) for x, (_, v, at), y in zip(p, parts, g, strict=True)])
        return np.array([d for d, _, _ in parts]), adjoint


def _products(steps: DataFrame) -> int:
    """How many products of entries make the square of a matrix (to, id, ...)."""
    rows, columns = steps.groupBy(F.col("to").alias("at")).agg(F.count(F.lit(1)).alias("a")), steps.groupBy(F.col("id").alias("at")).agg(F.count(F.lit(1)).alias("b"))
    return rows.join(columns, "at").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0


def _squared(steps: DataFrame) -> DataFrame:
    """From (to, id, w, c), the matrix of walks of m steps and its derivative by costs, to those of 2 m steps."""
    first = steps.select("to", F.col("id").alias("at"), "w", "c")
    then = steps.select(F.col("to").alias("at"), "id", F.col("w").alias("w2"), F.col("c").alias("c2"))
    w, c = F.sum(F.col("w") * F.col("w2")), F.sum(F.col("c") * F.col("w2") + F.col("w") * F.col("c2"))
    return first.join(then, "at").groupBy("to", "id").agg(w.alias("w"), c.alias("c"))


@dataclass(frozen=True)
class RSPDistance(Distance):
    """Expected cost of randomised shortest paths at inverse temperature ``theta``.

    ``cost`` is a column function of the weight (default -log) or a table (src, dst, cost).  Only
    the targets asked for are solved, twice each with one sparse factor (``method="direct"``: nested dissection of square tiles
    of a raster, else of consecutive ids), whatever the size and the signs of costs; "dense" does so in
    the tasks, and "auto" takes it for small graphs; "walks" are sums over walks, which converge for costs that are not negative; of small graphs twice as long ones a round.
    Vertices without a way out reach nothing but themselves.
    """

    theta: float
    cost: Callable[[Column], Column] | DataFrame | None = None
    method: str = "auto"
    rtol: float = 1e-12

    def cost_edges(self, graph) -> DataFrame:
        """(src, dst, weight, cost)"""
        edges = graph.edges()
        if isinstance(self.cost, DataFrame):
            return edges.join(self.cost.select("src", "dst", "cost"), ["src", "dst"])
        return edges.withColumn("cost", (self.cost or (lambda w: -F.log(w)))(F.col("weight")))

    def between(self, graph, sources, targets):
        goal = _everyone(graph) if targets is None else targets.distinct()
        table, n = self.cost_edges(graph), graph.nv
        method = ("dense" if n <= DENSE_VERTICES else "direct") if self.method == "auto" else self.method
        if method == "direct":
            found = self._direct(graph, table, goal)
        elif method in ("dense", "walks"):
            found = self._dense(table, n, goal) if method == "dense" else self._walks(table, goal)
        else:
            raise ValueError("method is one of auto, direct, dense, walks")
        return found if sources is None else found.join(sources.distinct().withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "distance")

    def _dense(self, table, n, goal):
        if n > DENSE_VERTICES:
            raise ValueError(f"dense paths are for up to {DENSE_VERTICES} vertices")
        rows, theta = table.toPandas(), self.theta
        w = (rows["src"].to_numpy(), rows["dst"].to_numpy())

        def run(parts):
            a, c = np.zeros((n, n)), np.zeros((n, n))
            a[w], c[w] = rows["weight"].to_numpy(), rows["cost"].to_numpy()
            for part in parts:
                t = part["id"].to_numpy()
                if len(t):
                    d = K.rsp(a, theta, c, t)
                    s, k = np.nonzero(np.isfinite(d))
                    yield pd.DataFrame({"src": s, "dst": t[k], "distance": d[s, k]})

        return goal.repartition(min(8, _tasks(goal))).mapInPandas(run, _RESULT)

    def _steps(self, table) -> DataFrame:
        """(to, id, w, cost): W, the random walk's probabilities times exp(-theta cost)."""
        total = algebra.degree(table.select("src", "dst", "weight")).withColumnRenamed("id", "src")
        w = (F.col("weight") / F.col("degree") * F.exp(-self.theta * F.col("cost"))).alias("w")
        return materialize(table.join(total, "src").select(F.col("src").alias("to"), F.col("dst").alias("id"), w, "cost"), "walk")

    def _direct(self, graph, table, goal):
        """(I - W) z = e_t and (I - W) y = (C W) z, both for all targets, with one factor."""
        steps = self._steps(materialize(table, "costs"))
        matrix = steps.select(F.col("to").alias("src"), F.col("id").alias("dst"), (-F.col("w")).alias("weight"))
        matrix = matrix.unionByName(_everyone(graph).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")))
        factor = factorize(matrix, Tiling.of_graph(graph, FRONT_SIDE), definite=False)
        z = materialize(factor.solve(goal.select("id", F.col("id").alias("rhs"), F.lit(1.0).alias("value"))), "walks")
        paid = z.join(steps, "id").groupBy(F.col("to").alias("id"), "rhs").agg(F.sum(F.col("cost") * F.col("w") * F.col("value")).alias("value"))
        y = factor.solve(paid).withColumnRenamed("value", "y")
        return self._minus_own(z.where("value > 0").join(y, ["id", "rhs"], "left").select(F.col("id").alias("src"), F.col("rhs").alias("dst"), (F.coalesce("y", F.lit(0.0)) / F.col("value")).alias("d")))

    def _minus_own(self, d: DataFrame) -> DataFrame:
        own = d.where("src = dst").select("dst", F.col("d").alias("own"))
        return d.join(own, "dst").select("src", "dst", (F.col("d") - F.col("own")).alias("distance"))

    def _walks(self, table, goal):
        """z = sum of W^k e_t and y = sum of its derivatives by costs, both for all targets, until they no longer grow.

        The matrix of walks of m steps is squared as long as that takes at most ``WALK_PRODUCTS`` products, so the sums over
        2 m steps come from those over m; after that a round adds m steps.
        """
        table = materialize(table, "costs")
        if not table.where("cost < 0").isEmpty():
            raise ValueError("sums over walks need costs of at least zero")
        steps = self._steps(table).select("to", "id", "w", (F.col("cost") * F.col("w")).alias("c"))
        part = total = materialize(goal.select("id", F.col("id").alias("t"), F.lit(1.0).alias("z"), F.lit(0.0).alias("y")), "walks")
        squared = 0
        while squared <= WALK_DOUBLINGS:
            onward = part.join(steps, "id").groupBy(F.col("to").alias("id"), "t")
            new = materialize(onward.agg(F.sum(F.col("w") * F.col("z")).alias("z"), F.sum(F.col("w") * F.col("y") + F.col("c") * F.col("z")).alias("y")), "walks")
            total = materialize(total.unionByName(new).groupBy("id", "t").agg(F.sum("z").alias("z"), F.sum("y").alias("y")), "walks")
            left = new.join(total.select("id", "t", F.col("z").alias("zz"), F.col("y").alias("yy")), ["id", "t"])
            if left.where((F.col("z") > self.rtol * F.col("zz")) | (F.col("y") > self.rtol * F.col("yy"))).isEmpty():
                return self._minus_own(total.where("z > 0").select(F.col("id").alias("src"), F.col("t").alias("dst"), (F.col("y") / F.col("z")).alias("d")))
            part = new
            if _products(steps) <= WALK_PRODUCTS:
                part, steps, squared = total, materialize(_squared(steps), "walk"), squared + 1
        raise ValueError("the sums over walks do not converge: some walks never end and cost nothing")

    def in_windows(self, p):
        if self.cost is not None:
            raise ValueError("windows take the default cost of randomised paths")
        _, h, w = p.shape
        at = h // 2 * w + w // 2
        adjoint = lambda g: np.array([K.window_rsp_adjoint(x, at, self.theta, y) for x, y in zip(p, g, strict=True)])
        return np.array([K.window_rsp(x, at, self.theta) for x in p]), adjoint
