"""Overlapping windows over a raster: a core, surrounded by a buffer.

The windows that cover a cell are computed from its indices and exploded, so dealing cells to
windows is an equi-join, never a range join, and a raster is one table of window cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..raster import Raster


@dataclass(frozen=True)
class WindowSpec:
    """Windows with cores of ``window`` cells, every ``window`` cells, and ``buffer`` around them."""

    shape: tuple[int, int]
    window: int
    buffer: int

    def __post_init__(self):
        if not all(isinstance(x, int) for x in (*self.shape, self.window, self.buffer)):
            raise TypeError("shape, window and buffer are integers")
        if self.window < 1 or self.buffer < 0:
            raise ValueError("the window is at least 1, the buffer at least 0")
        inner = [n - 2 * self.buffer for n in self.shape]
        if any(n < self.window or n % self.window for n in inner):
            raise ValueError(f"the shape {self.shape} without twice the buffer {self.buffer} is not whole windows of {self.window}")

    @property
    def total(self) -> int:
        return self.window + 2 * self.buffer

    @property
    def x_steps(self) -> int:
        return (self.shape[0] - 2 * self.buffer) // self.window

    @property
    def y_steps(self) -> int:
        return (self.shape[1] - 2 * self.buffer) // self.window

    @property
    def nb_steps(self) -> int:
        return self.x_steps * self.y_steps

    def origin(self, window_id: int) -> tuple[int, int]:
        if not 0 <= window_id < self.nb_steps:
            raise ValueError(f"window {window_id} of {self.nb_steps}")
        return window_id // self.y_steps * self.window, window_id % self.y_steps * self.window

    def table(self, spark) -> DataFrame:
        """(window_id, x0, y0), by rows: the top left of each whole window."""
        ids = spark.range(self.nb_steps).withColumnRenamed("id", "window_id")
        return ids.select("window_id", (F.floor(F.col("window_id") / self.y_steps) * self.window).cast("int").alias("x0"), (F.pmod("window_id", F.lit(self.y_steps)) * self.window).cast("int").alias("y0"))

    def _covering(self, at: Column, steps: int, total: int, shift: int) -> Column:
        low = F.greatest(F.lit(0), F.ceil((at - shift - total + 1) / F.lit(float(self.window))).cast("int"))
        high = F.least(F.lit(steps - 1), F.floor((at - shift) / F.lit(float(self.window))).cast("int"))
        return F.when(low <= high, F.sequence(low, F.greatest(low, high)))

    def _cells(self, cells: DataFrame, total: int, shift: int) -> DataFrame:
        keep = [c for c in cells.columns if c not in ("row", "col")]
        dealt = cells.select("row", "col", *keep, F.explode(self._covering(F.col("row"), self.x_steps, total, shift)).alias("wx"))
        dealt = dealt.select("row", "col", *keep, "wx", F.explode(self._covering(F.col("col"), self.y_steps, total, shift)).alias("wy"))
        return dealt.select(
            (F.col("wx").cast("long") * self.y_steps + F.col("wy")).alias("window_id"),
            "row",
            "col",
            (F.col("row") - F.col("wx") * self.window - shift).alias("local_row"),
            (F.col("col") - F.col("wy") * self.window - shift).alias("local_col"),
            *keep,
        )

    def total_cells(self, cells: DataFrame) -> DataFrame:
        """(window_id, row, col, local_row, local_col, ...) of all windows with their buffers."""
        return self._cells(cells, self.total, 0)

    def core_cells(self, cells: DataFrame) -> DataFrame:
        """The same of the cores, which do not overlap."""
        return self._cells(cells, self.window, self.buffer)

    def one(self, cells: DataFrame, window_id: int, core: bool = False) -> DataFrame:
        """(local_row, local_col, value) of one window, by a filter on the indices."""
        (x, y), size, shift = self.origin(window_id), self.window if core else self.total, self.buffer if core else 0
        inside = cells.where(F.col("row").between(x + shift, x + shift + size - 1) & F.col("col").between(y + shift, y + shift + size - 1))
        return inside.select((F.col("row") - x - shift).alias("local_row"), (F.col("col") - y - shift).alias("local_col"), "value")

    def iterate(self, raster: Raster) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        """((x0, y0), array) of each window in turn, in the order of ids; a row of windows is read at a time."""
        for wx in range(self.x_steps):
            x, band = wx * self.window, np.full((self.total, self.shape[1]), np.nan)
            for r in raster.cells.where(F.col("row").between(x, x + self.total - 1)).toLocalIterator():
                band[r.row - x, r.col] = np.nan if r.value is None else r.value
            for wy in range(self.y_steps):
                yield (x, wy * self.window), band[:, wy * self.window : wy * self.window + self.total]


def replace(current: Column, new: Column) -> Column:
    return new


def add(current: Column, new: Column) -> Column:
    return F.coalesce(current, F.lit(0.0)) + new


def merge_cores(raster: Raster, cores: DataFrame, fun: Callable[[Column, Column], Column] = replace) -> Raster:
    """Merge core cells (row, col, value) into a raster; what no core covers stays."""
    new = cores.select("row", "col", F.col("value").alias("_new"))
    met = raster.cells.join(new, ["row", "col"], "left")
    return Raster(met.select("row", "col", F.when(F.col("_new").isNull(), F.col("value")).otherwise(fun(F.col("value"), F.col("_new"))).alias("value")), *raster.shape)


def overlap_add(windows: DataFrame) -> DataFrame:
    """(row, col, value): the sum of all windows' values (row, col, value) at each cell."""
    return windows.groupBy("row", "col").agg(F.sum("value").alias("value"))


def overlap_last(windows: DataFrame) -> DataFrame:
    """The value of the last window, by id, at each cell."""
    return windows.groupBy("row", "col").agg(F.max_by("value", "window_id").alias("value"))


def merge_windows(raster: Raster, windows: DataFrame, how: str | Callable[[Column, Column], Column] = "replace") -> Raster:
    """Merge whole windows (window_id, row, col, value), which overlap, into a raster.

    ``how`` is "replace" (the last window wins), "add", or a function of the current and the new
    value that is applied in the order of window ids.
    """
    if how == "add":
        return merge_cores(raster, overlap_add(windows), add)
    if how == "replace":
        return merge_cores(raster, overlap_last(windows))
    ordered = windows.groupBy("row", "col").agg(F.sort_array(F.collect_list(F.struct("window_id", "value"))).alias("_w"))  # a cell lies in few windows
    met = raster.cells.join(ordered, ["row", "col"], "left")
    folded = F.aggregate(F.coalesce("_w", F.array().cast(ordered.schema["_w"].dataType)), F.col("value"), lambda acc, w: how(acc, w["value"]))
    return Raster(met.select("row", "col", folded.alias("value")), *raster.shape)


def ranked_windows(spec: WindowSpec, cells: DataFrame) -> DataFrame:
    """Window cells with their place in the window, 0 and up by rows."""
    return spec.total_cells(cells).withColumn("place", F.row_number().over(W.partitionBy("window_id").orderBy("row", "col")) - 1)
