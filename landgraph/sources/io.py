"""Rasters, matrices and sites from files, and results to files."""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..raster import Raster


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of one text file, lines from 0, read in splits by many tasks.

    The lines of each split are counted first, and those of the splits before it are added to a line's place in its own.
    """
    table = spark.read.text(path)
    if len(files := table.inputFiles()) != 1:
        raise ValueError(f"{path} names {len(files)} files; lines are numbered within one")
    # a split is read in order and by one task, so within it these ids go up by one
    lines = table.select(F.col("value").alias("text"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("split")) - F.col("n")  # a row for each split
    return lines.join(F.broadcast(counts.select("split", (before - F.col("first")).alias("shift"))), "split").select((F.col("at") + F.col("shift")).alias("line"), "text")


def read_csv_raster(spark: SparkSession, path: str, separator: str = ",", nodata: str = "keep") -> Raster:
    """A dense matrix without a header: one line of one file for each row, read by as many tasks as the file has splits.

    Empty fields and NA are NaN.  A blank line is a row without cells.
    """
    field = F.trim("field")
    value = F.when(field.isin("", "NA"), float("nan")).otherwise(field.cast("double"))
    fields = numbered_lines(spark, path).where(F.trim("text") != "").select(F.col("line").cast("int").alias("row"), F.posexplode(F.split("text", F.lit(re.escape(separator)))).alias("col", "field"))
    return Raster.of(fields.select("row", "col", value.alias("value")), nodata=nodata)


def read_npy_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, value) of a matrix saved by numpy."""

    def parse(parts):
        for part in parts:
            for content in part["content"]:
                a = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                i, j = np.indices(a.shape)
                yield pd.DataFrame({"src": i.ravel(), "dst": j.ravel(), "value": a.ravel().astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "src long, dst long, value double")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, x, y) from CSV with a header, or Parquet; coordinates are those of the raster."""
    schema = "site_id string, x double, y double"
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema(schema).csv(path, header=True)


def read_cells(spark: SparkSession, path: str, nodata: str = "keep") -> Raster:
    """A raster saved by ``write_cells``."""
    return Raster.of(spark.read.parquet(path), nodata=nodata)


def write_cells(raster: Raster, path: str, tile: int = 1024) -> None:
    """Parquet, partitioned by rows of tiles (``band``), of which a reader that filters by it reads only some."""
    raster.cells.withColumn("band", F.floor(F.col("row") / tile).cast("int")).write.partitionBy("band").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def dense_rows(matrix: DataFrame) -> DataFrame:
    """(src, dst, weight) of (src, weights): the non-zero entries of dense rows."""
    return matrix.select("src", F.posexplode("weights").alias("dst", "weight")).where("weight <> 0")
