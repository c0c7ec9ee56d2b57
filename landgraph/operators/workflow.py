"""Steps around an analysis: scaling, masks, selections, sampling, coarse classes, fit figures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..raster import Raster


def scale_fill(raster: Raster, divisor: float = 100.0, floor: float = 0.0) -> Raster:
    """Nodata to 0, divided, and a floor added for stability."""
    return raster.map(lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) / divisor + floor)


def mask_barriers(values: DataFrame, permeability: Raster, limit: float = 0.1) -> DataFrame:
    """``value`` becomes null where the permeability is at most ``limit``."""
    p = permeability.cells.select("row", "col", F.col("value").alias("_p"))
    return values.join(p, ["row", "col"], "left").withColumn("value", F.when(F.col("_p") > limit, F.col("value"))).drop("_p")


def average_path_length(distances: DataFrame, nv: int) -> DataFrame:
    """One row: the sum of distances over the square of the number of vertices."""
    return distances.agg((F.sum("distance") / float(nv) ** 2).alias("average_path_length"))


def elasticity(sensitivity: DataFrame, permeability: Raster) -> DataFrame:
    """(row, col, elasticity): sensitivity times value, NaN as 0."""
    p = permeability.cells.select("row", "col", "value")
    return sensitivity.join(p, ["row", "col"]).select("row", "col", F.nanvl(F.col("sensitivity") * F.col("value"), F.lit(0.0)).alias("elasticity"))


#: Bins of a histogram, and how often it is refined.
BINS, REFINED = 2_048, 3


def quantiles(cells: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """(share, cut): exact, interpolated quantiles of the values that are not null, one row for each share; a plan, no action.

    The values whose ranks are asked for are closed in on by histograms: of the values left for a rank the bin is
    kept that holds it, with its least and greatest value, ``REFINED`` times; then the different values left are counted.  No
    task sees more than the bins, or the different values of one bin of the last histogram.
    """
    values = cells.select(F.col(column).cast("double").alias("v")).where("v is not null")
    of = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    exact = F.col("share") * (F.col("n") - 1)
    below, part = F.floor(exact), exact - F.floor(exact)
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), below.alias("rank"), (1 - part).alias("part")), F.struct(F.lit(1).alias("end"), (below + 1).alias("rank"), part.alias("part")))).alias("r")
    asked = of.where("n > 0").select("n", "low", "high", at).select("share", ends, "low", "high")
    asked = asked.select("share", "r.end", "r.part", "r.rank", "low", "high").where("part > 0")
    key = ("share", "end", "part", "rank")

    def holding(counted: DataFrame, by: str) -> DataFrame:
        """The row of each rank in which it lies, with the rank within that row."""
        before = F.sum("n").over(W.partitionBy(*key).orderBy(by)) - F.col("n")
        met = counted.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        return met.withColumn("rank", F.col("rank") - F.col("before"))

    for _ in range(REFINED):
        left = values.join(F.broadcast(asked), (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))  # two rows a share
        wide = F.col("high") - F.col("low")
        place = F.when(wide > 0, F.least(F.floor((F.col("v") - F.col("low")) / wide * BINS), F.lit(BINS - 1))).otherwise(0)
        bins = left.groupBy(*key, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        asked = holding(bins, "bin").select(*key, "low", "high")
    left = values.join(F.broadcast(asked), (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    found = holding(left.groupBy(*key, "v").agg(F.count(F.lit(1)).alias("n")), "v")
    return found.groupBy("share").agg(F.sum(F.col("part") * F.col("v")).alias("cut"))


def above_percentile(cells: DataFrame, column: str, share: float = 0.95) -> DataFrame:
    """The rows whose ``column`` is at least its ``share`` quantile (exact, interpolated)."""
    return cells.join(F.broadcast(quantiles(cells, column, [share]).select(F.col("cut").alias("_cut"))), F.col(column) >= F.col("_cut")).drop("_cut")


def sample_cells(cells: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """``n`` rows without replacement, those of the smallest hash of keys and seed."""
    return cells.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def update_cells(raster: Raster, updates: DataFrame) -> Raster:
    """A scenario: the cells of ``updates`` (row, col, value) replace those of the raster."""
    new = updates.select("row", "col", F.col("value").alias("_new"))
    return Raster(raster.cells.join(new, ["row", "col"], "left").select("row", "col", F.coalesce("_new", "value").alias("value")), *raster.shape)


def percent_gain(before: DataFrame, after: DataFrame, column: str = "connectivity") -> DataFrame:
    """One row (before, after, gain) of two one-row tables."""
    a = before.select(F.col(column).alias("before"), F.lit(0).alias("k"))
    b = after.select(F.col(column).alias("after"), F.lit(0).alias("k"))
    return a.join(b, "k").select("before", "after", (100 * (F.col("after") - F.col("before")) / F.col("before")).alias("gain"))


def class_ids(df: DataFrame, column: str) -> DataFrame:
    """Add ``class_id``: 0, 1, ... by the order of the distinct values.

    Only the distinct values are ranked, so the table itself never meets in one task.
    """
    table = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("class_id", F.dense_rank().over(W.orderBy(column)) - 1)
    return df.join(table, column, "left")


def one_hot_classes(cells: DataFrame, column: str = "class_id") -> DataFrame:
    """(row, col, class_id, value): 1 for the class of each cell; absent rows are 0."""
    return cells.select("row", "col", F.col(column).alias("class_id"), F.lit(1.0).alias("value"))


def block_mean(cells: DataFrame, factor: int, height: int, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Means of whole blocks of ``factor`` cells, [by ``keys``]; the rest at the border is cut off.

    A value that is absent in a block counts as 0.
    """
    inside = cells.where((F.col("row") < height // factor * factor) & (F.col("col") < width // factor * factor))
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return inside.groupBy(*block, *keys).agg((F.sum("value") / factor**2).alias("value"))


def nearest_cell(sites: DataFrame, xs: Sequence[float], ys: Sequence[float]) -> DataFrame:
    """Add ``row`` and ``col``: the nearest of the coordinates of rows (``ys``) and columns (``xs``), the first if two are."""
    def nearest(at: str, axis: Sequence[float]) -> Column:
        gaps = F.transform(F.array(*(F.lit(float(a)) for a in axis)), lambda a: F.abs(a - F.col(at)))
        return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")

    return sites.withColumns({"row": nearest("y", ys), "col": nearest("x", xs)})


def unordered_pairs(a: DataFrame, key: str = "id") -> DataFrame:
    """(i, j) of all i < j of a vertex table, as asked for when pair distances are observed."""
    return a.select(F.col(key).alias("i")).crossJoin(a.select(F.col(key).alias("j"))).where("i < j")


def split_rows(df: DataFrame, keys: Sequence[str], share: float = 0.8, seed: int = 0) -> DataFrame:
    """Add ``train``: true for about ``share`` of the keys, by a hash."""
    return df.withColumn("train", F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(10_000)) < int(share * 10_000))


def fit_figures(df: DataFrame, observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """One row (mse, rmse, r2)."""
    o, p = F.col(observed), F.col(predicted)
    figures = df.agg(F.avg(F.pow(o - p, 2)).alias("mse"), F.var_pop(o).alias("v"))
    return figures.select("mse", F.sqrt("mse").alias("rmse"), F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2"))


def clipped_log(cells: DataFrame, column: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Add ``clipped``: the logarithm of positive values between two of its quantiles."""
    logs = cells.withColumn("clipped", F.when(F.col(column) > 0, F.log(column)))
    cuts = quantiles(logs, "clipped", [low, high]).agg(F.min("cut").alias("_a"), F.max("cut").alias("_b"))
    clipped = F.when(F.col("clipped").isNotNull(), F.least(F.greatest("clipped", F.col("_a")), F.col("_b")))
    return logs.crossJoin(F.broadcast(cuts)).withColumn("clipped", clipped).drop("_a", "_b")


def squared_sum(distances: DataFrame) -> DataFrame:
    """One row: the sum of squared distances."""
    return distances.agg(F.sum(F.pow("distance", 2)).alias("objective"))


def predict_cells(cells: DataFrame, features: Sequence[str], model: Callable[[np.ndarray], np.ndarray], limit: float = 1e3) -> DataFrame:
    """Add ``predicted``: exp of a numpy model of the features, at most ``limit``, in Arrow batches."""

    @F.pandas_udf(T.DoubleType())
    def predicted(*columns: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(np.exp(model(np.stack([c.to_numpy(dtype=float) for c in columns], axis=1))), limit))

    return cells.withColumn("predicted", predicted(*features))


def fit(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 100, memory: int = 8, tolerance: float = 1e-9) -> np.ndarray:
    """L-BFGS with backtracking, on the driver; ``loss`` runs the Spark job and returns value and gradient."""
    x = np.asarray(start, dtype=float)
    value, gradient = loss(x)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.linalg.norm(gradient) <= tolerance:
            break
        q, alphas = gradient.copy(), []
        for s, y in reversed(history):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if history:
            q *= history[-1][0] @ history[-1][1] / (history[-1][1] @ history[-1][1])
        for (s, y), a in zip(history, reversed(alphas), strict=True):
            q += (a - y @ q / (s @ y)) * s
        step = 1.0
        while True:
            new, (new_value, new_gradient) = x - step * q, loss(x - step * q)
            if new_value <= value - 1e-4 * step * (gradient @ q) or step < 1e-10:
                break
            step /= 2
        s, y = new - x, new_gradient - gradient
        if s @ y > 1e-14:
            history = [*history, (s, y)][-memory:]
        done = abs(value - new_value) <= tolerance * max(1.0, abs(value))
        x, value, gradient = new, new_value, new_gradient
        if done:
            break
    return x
