"""Rescoring as cells change: each micro-batch of changed cells touches only the tiles it lies in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import WindowSpec
from ..operators.workflow import update_cells
from ..raster import Raster


def changed_tiles(spec: WindowSpec, changes: DataFrame) -> DataFrame:
    """(window_id) of the tiles that a change (row, col) reaches, buffers included."""
    return spec.total_cells(changes.select("row", "col")).select("window_id").distinct()


def rescore(stream: DataFrame, raster: Raster, spec: WindowSpec, score: Callable[[Raster, DataFrame], DataFrame], sink: str, checkpoint: str):
    """Start a query that keeps ``raster`` up to date with (row, col, value) and appends to ``sink``
    what ``score(raster, tiles)`` returns for the tiles each micro-batch reaches, with its number.

    The changes of all batches so far are kept beside the sink and applied, the last one for each
    cell, so a batch that is run again gives the same rows under the same number.
    """
    changes = f"{sink}-changes"

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.select("row", "col", "value").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{changes}/number={number:09d}")
        seen = spark.read.parquet(changes).where(F.col("batch") <= number)
        last = seen.groupBy("row", "col").agg(F.max_by("value", "batch").alias("value"))
        tiles = changed_tiles(spec, df)
        score(update_cells(raster, last), tiles).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/number={number:09d}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
