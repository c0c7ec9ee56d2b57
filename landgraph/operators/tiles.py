"""Vertices in tiles, and tiles in larger tiles: the common ground of search, elimination and aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tiling:
    """Square tiles of ``side`` x ``side`` cells of a raster ``width`` wide; without a width, side * side consecutive ids.

    A tile of level l holds 2^l x 2^l tiles of level 0 of a raster, 2^l of consecutive ids.
    """

    side: int
    width: int | None = None

    @classmethod
    def of_graph(cls, graph, side: int) -> Tiling:
        return cls(side, getattr(graph, "width", None))

    def places(self, id_: Column) -> tuple[Column, ...]:
        """The coordinates of a vertex's tile of level 0."""
        if self.width is None:
            return (F.floor(id_ / (self.side * self.side)),)
        return F.floor(F.floor(id_ / self.width) / self.side), F.floor(F.pmod(id_, F.lit(self.width)) / self.side)

    def tile(self, id_: Column, level: int | Column = 0) -> Column:
        """The number of a vertex's tile, unique within its level."""
        up = (lambda x: F.shiftright(x, level)) if isinstance(level, int) else (lambda x: F.call_function("shiftright", x, level.cast("int")))
        places = [up(p.cast("long")) for p in self.places(id_)]
        if len(places) == 1:
            return places[0]
        across = -(-self.width // self.side)
        return places[0] * across + places[1]

    def meeting(self, a: Column, b: Column) -> Column:
        """The lowest level at which two vertices are in one tile."""
        apart = [x.cast("long").bitwiseXOR(y.cast("long")) for x, y in zip(self.places(a), self.places(b), strict=True)]
        levels = [F.when(x == 0, 0).otherwise(F.length(F.bin(x))) for x in apart]
        return (F.greatest(*levels) if len(levels) > 1 else levels[0]).cast("int")
