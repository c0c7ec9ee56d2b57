"""Sums of neighbourhoods and coarse rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..raster import Raster


def sum_neighborhood(raster: Raster, targets: DataFrame, npix: int) -> DataFrame:
    """(row, col, value): sums over the square of 2 npix + 1 cells around each target.

    NaN and null count as 0, as does what lies outside.
    """
    span = lambda c: F.explode(F.sequence(F.col(c) - npix, F.col(c) + npix))
    around = targets.select(F.col("row").alias("r"), F.col("col").alias("c")).withColumn("row", span("r")).withColumn("col", span("c"))
    met = around.join(raster.cells, ["row", "col"], "left")
    return met.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0))).alias("value"))


def coarse_grain(raster: Raster, buffer: int) -> Raster:
    """The mean of each block of 2 buffer + 1 cells, at the block's centre; other cells are absent."""
    size = 2 * buffer + 1
    if raster.height % size or raster.width % size:
        raise ValueError(f"the shape {raster.shape} is not whole blocks of {size}")
    block = raster.cells.groupBy(F.floor(F.col("row") / size).alias("i"), F.floor(F.col("col") / size).alias("j")).agg((F.sum("value") / size**2).alias("value"))
    return Raster(block.select((F.col("i") * size + buffer).cast("int").alias("row"), (F.col("j") * size + buffer).cast("int").alias("col"), "value"), *raster.shape)
