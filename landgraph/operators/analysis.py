"""Windowed connectivity and its sensitivity.

The raster is cut into tiles: cores of ``batch_size`` windows and the same buffer.  Tiles are dealt
to tasks as rows of cells; a task cuts the windows out of the dense tile.  A tile is of bounded
size, so memory does not depend on the raster, and cells are repeated for few tiles instead of for
every window that covers them.  Any ``Distance`` serves that defines ``in_windows``.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.proximity import Custom
from ..raster import Raster, padded_shape
from .distance import Distance
from .windows import WindowSpec


class WindowedAnalysis(ABC):
    """Parameters of an analysis of windows; subclasses implement ``run``.

    ``permeability`` is a raster or a column function of quality.  ``coarsening_factor`` c in [0, 1]
    sets the core to ceil(c * dependency_range) cells, made odd; the buffer is what then remains of
    the range.  Rasters are padded with zeros to whole tiles.
    """

    def __init__(self, quality: Raster, permeability: Raster | Callable[[Column], Column], distance: Distance, proximity, dependency_range: int, batch_size: int, coarsening_factor: float = 0.0):
        if not isinstance(dependency_range, int) or not isinstance(batch_size, int):
            raise TypeError("dependency_range and batch_size are integers")
        if not 0 <= coarsening_factor <= 1:
            raise ValueError("coarsening_factor lies in [0, 1]")
        core = math.ceil(dependency_range * coarsening_factor) | 1  # odd, so that it has a centre
        buffer = dependency_range - core // 2  # the centre sees as far as the range
        if buffer < 1:
            raise ValueError(f"a core of {core} cells leaves no buffer within a range of {dependency_range}")
        permeability = quality.map(permeability) if callable(permeability) else permeability
        if quality.shape != permeability.shape:
            raise ValueError("both rasters have the same shape")
        self.quality, self.permeability, self.distance = quality, permeability, distance
        self.proximity = proximity if hasattr(proximity, "derivative") else Custom(proximity)
        self.core, self.buffer = core, buffer
        self.shape = padded_shape(quality.shape, buffer, batch_size * core)
        self.tiles = WindowSpec(self.shape, batch_size * core, buffer)
        self.windows = WindowSpec((self.tiles.total, self.tiles.total), core, buffer)

    def tile_cells(self) -> DataFrame:
        """(window_id, local_row, local_col, q, p) of all tiles; every tile has one row at least."""
        q = self.quality.cells.select("row", "col", F.col("value").alias("q"))
        both = q.join(self.permeability.cells.select("row", "col", F.col("value").alias("p")), ["row", "col"], "full")
        cells = self.tiles.total_cells(both).select("window_id", "local_row", "local_col", "q", "p")
        spark = cells.sparkSession
        none = F.lit(None)
        marks = self.tiles.table(spark).select("window_id", F.lit(0).alias("local_row"), F.lit(0).alias("local_col"), none.cast("double").alias("q"), none.cast("double").alias("p"))
        return cells.unionByName(marks)

    def per_tile(self, f: Callable[[int, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
        """Apply ``f(tile id, quality, permeability)`` to the dense arrays of each tile."""
        total = self.tiles.total

        def run(part: pd.DataFrame) -> pd.DataFrame:
            q, p = np.zeros((total, total)), np.zeros((total, total))
            at = part["local_row"].to_numpy(), part["local_col"].to_numpy()
            for array, name in ((q, "q"), (p, "p")):
                np.add.at(array, at, np.nan_to_num(part[name].to_numpy(dtype=float)))
            return f(int(part["window_id"].iloc[0]), q, p)

        return self.tile_cells().groupBy("window_id").applyInPandas(run, schema)

    @abstractmethod
    def run(self, **options) -> DataFrame:
        """The result of the analysis."""


def _cut(tile: np.ndarray, spec: WindowSpec) -> np.ndarray:
    """(windows, total, total) of a tile, by rows."""
    views = np.lib.stride_tricks.sliding_window_view(tile, (spec.total, spec.total))[:: spec.window, :: spec.window]
    return views.reshape(-1, spec.total, spec.total)


def _proximities(proximity, d: np.ndarray, core: slice) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        k = np.where(np.isfinite(d), proximity.value(np.where(np.isfinite(d), d, 1.0)), 0.0)
    k[:, core, core] = 0.0
    return k


class ConnectivityAnalysis(WindowedAnalysis):
    """The sum over windows of core quality times what is in proximity of the centre."""

    def per_window(self, q_weighted: bool = True) -> DataFrame:
        """(window_id, connectivity) of each tile."""
        spec, metric, proximity, core = self.windows, self.distance, self.proximity, slice(self.buffer, self.buffer + self.core)

        def one(tile: int, q: np.ndarray, p: np.ndarray) -> pd.DataFrame:
            qs, ps = _cut(q, spec), _cut(p, spec)
            k = _proximities(proximity, metric.in_windows(ps)[0], core)
            c = (qs[:, core, core].sum(axis=(1, 2)) * (k * qs).sum(axis=(1, 2))) if q_weighted else k.sum(axis=(1, 2))
            return pd.DataFrame({"window_id": [tile], "connectivity": [float(c.sum())]})

        return self.per_tile(one, "window_id long, connectivity double")

    def run(self, q_weighted: bool = True) -> DataFrame:
        """One row (connectivity)."""
        return self.per_window(q_weighted).agg(F.sum("connectivity").alias("connectivity"))


class SensitivityAnalysis(WindowedAnalysis):
    """The gradient of connectivity by every cell's quality or permeability."""

    def run(self, var: str = "quality", q_weighted: bool = True) -> DataFrame:
        """(row, col, sensitivity) of the cells of the unpadded raster.

        Windows that reach into the padding are left out.  By quality, unweighted, it is zero.
        """
        if var not in ("quality", "permeability"):
            raise ValueError("var is quality or permeability")
        spec, tiles, metric, proximity, shape = self.windows, self.tiles, self.distance, self.proximity, self.quality.shape
        core = slice(self.buffer, self.buffer + self.core)

        def one(tile: int, q: np.ndarray, p: np.ndarray) -> pd.DataFrame:
            x0, y0 = tiles.origin(tile)
            starts = [(x * spec.window, y * spec.window) for x in range(spec.x_steps) for y in range(spec.y_steps)]
            inside = [k for k, (x, y) in enumerate(starts) if x0 + x + spec.total <= shape[0] and y0 + y + spec.total <= shape[1]]
            out = np.zeros_like(q)
            if inside:
                qs, ps = _cut(q, spec)[inside], _cut(p, spec)[inside]
                d, adjoint = metric.in_windows(ps)
                k, mass = _proximities(proximity, d, core), qs[:, core, core].sum(axis=(1, 2))[:, None, None]
                if var == "quality":
                    g = mass * k if q_weighted else np.zeros_like(k)
                    if q_weighted:
                        g[:, core, core] += (k * qs).sum(axis=(1, 2))[:, None, None]
                else:
                    slope = np.where(np.isfinite(d), proximity.derivative(np.where(np.isfinite(d), d, 1.0)), 0.0)
                    slope[:, core, core] = 0.0
                    g = adjoint(mass * qs * slope if q_weighted else slope)
                for (x, y), part in zip((starts[k] for k in inside), g, strict=True):
                    out[x : x + spec.total, y : y + spec.total] += part
            row, col = np.nonzero(out)
            return pd.DataFrame({"row": (row + x0).astype(np.int32), "col": (col + y0).astype(np.int32), "g": out[row, col]})

        parts = self.per_tile(one, "row int, col int, g double").groupBy("row", "col").agg(F.sum("g").alias("g"))
        cells = self.quality.dense().cells.select("row", "col")
        return cells.join(parts, ["row", "col"], "left").select("row", "col", F.coalesce("g", F.lit(0.0)).alias("sensitivity"))
