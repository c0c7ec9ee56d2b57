"""Rasters as tables of cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = ("keep", "barrier", "zero")


def vertex(row: Column, col: Column, width: int) -> Column:
    """The row-major vertex id of a cell."""
    return row.cast("long") * width + col.cast("long")


@dataclass(frozen=True)
class Raster:
    """Cells (row INT, col INT, value DOUBLE) of a ``height`` x ``width`` grid; a cell may be absent."""

    cells: DataFrame
    height: int
    width: int

    def __post_init__(self):
        if missing := {"row", "col", "value"} - set(self.cells.columns):
            raise ValueError(f"a raster needs the columns row, col and value; missing: {sorted(missing)}")
        if self.height < 1 or self.width < 1:
            raise ValueError("a raster has at least one row and one column")

    @classmethod
    def of(cls, cells: DataFrame, height: int | None = None, width: int | None = None, nodata: str = "keep") -> Raster:
        """From cells; the shape is that of the largest indices unless given.

        ``nodata`` says what becomes of null and NaN values: they are kept, dropped (the cell then
        has no edges), or made zero.
        """
        if nodata not in NODATA:
            raise ValueError(f"nodata is one of {NODATA}")
        cells = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
        if height is None or width is None:
            h, w = cells.agg(F.max("row"), F.max("col")).first()
            height, width = (height or (h or 0) + 1), (width or (w or 0) + 1)
        none = F.col("value").isNull() | F.isnan("value")
        if nodata == "barrier":
            cells = cells.where(~none)
        elif nodata == "zero":
            cells = cells.withColumn("value", F.when(none, 0.0).otherwise(F.col("value")))
        return cls(cells, height, width)

    @classmethod
    def from_array(cls, spark: SparkSession, rows: Sequence[Sequence[float]], nodata: str = "keep") -> Raster:
        """From a small dense array."""
        cells = [(i, j, None if v is None else float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)]
        return cls.of(spark.createDataFrame(cells, "row int, col int, value double"), len(rows), len(rows[0]), nodata)

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    @property
    def nv(self) -> int:
        return self.height * self.width

    def map(self, f: Callable[[Column], Column]) -> Raster:
        """A raster of ``f`` of the values."""
        return Raster(self.cells.withColumn("value", f(F.col("value"))), *self.shape)

    def node_values(self) -> DataFrame:
        """(id, value) by vertex id."""
        return self.cells.select(vertex(F.col("row"), F.col("col"), self.width).alias("id"), "value")

    @classmethod
    def from_node_values(cls, values: DataFrame, height: int, width: int) -> Raster:
        """The raster of (id, value)."""
        return cls(values.select(F.floor(F.col("id") / width).cast("int").alias("row"), F.pmod("id", F.lit(width)).cast("int").alias("col"), "value"), height, width)

    def rows(self) -> DataFrame:
        """(row, values): the values of each row as an array in the order of columns."""
        return self.cells.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda s: s["value"]).alias("values"))

    def dense(self, fill: float = 0.0) -> Raster:
        """All cells; absent ones get ``fill``."""
        spark = self.cells.sparkSession
        grid = spark.range(self.height).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(self.width - 1))).alias("col"))
        return Raster(grid.join(self.cells, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(fill)).alias("value")), *self.shape)

    def pad(self, buffer: int, window: int) -> Raster:
        """Zeros below and to the right, so that the inside of the ``buffer`` is whole windows."""
        h, w = padded_shape(self.shape, buffer, window)
        return Raster(self.cells, h, w).dense()

    def pad_border(self, n: int) -> Raster:
        """A ring of ``n`` zero cells on all sides."""
        moved = self.cells.select((F.col("row") + n).alias("row"), (F.col("col") + n).alias("col"), "value")
        return Raster(moved, self.height + 2 * n, self.width + 2 * n).dense()


def padded_shape(shape: tuple[int, int], buffer: int, window: int) -> tuple[int, int]:
    return tuple(n + (-(n - 2 * buffer)) % window for n in shape)


def coord_to_index(df: DataFrame, width: int, row: str = "row", col: str = "col") -> DataFrame:
    """Add ``id``; nothing is checked against the grid's bounds."""
    return df.withColumn("id", vertex(F.col(row), F.col(col), width))


def index_to_coord(df: DataFrame, width: int, id_column: str = "id") -> DataFrame:
    """Add ``row`` and ``col``."""
    return df.withColumns({"row": F.floor(F.col(id_column) / width).cast("int"), "col": F.pmod(F.col(id_column), F.lit(width)).cast("int")})
