"""Boxes as Column expressions: origin top left, ``x0 <= x1`` and ``y0 <= y1``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four edge columns and what follows from them."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def named(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{edge}") for edge in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def center_x(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def center_y(self) -> Column:
        return (self.y0 + self.y1) / 2

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def valid(self) -> Column:
        return (self.x1 >= self.x0) & (self.y1 >= self.y0)

    def meet(self, other: Box) -> Box:
        """Edges of the common part; only a box where :meth:`intersects` holds."""
        return Box(F.greatest(self.x0, other.x0), F.greatest(self.y0, other.y0), F.least(self.x1, other.x1), F.least(self.y1, other.y1))

    def intersects(self, other: Box) -> Column:
        """Touching counts; unknown where an edge is."""
        return (self.x0 <= other.x1) & (self.x1 >= other.x0) & (self.y0 <= other.y1) & (self.y1 >= other.y0)

    def contains(self, other: Box) -> Column:
        """Edges included."""
        return (self.x0 <= other.x0) & (self.y0 <= other.y0) & (self.x1 >= other.x1) & (self.y1 >= other.y1)

    def holds_center_of(self, other: Box) -> Column:
        return other.center_x.between(self.x0, self.x1) & other.center_y.between(self.y0, self.y1)

    def overlap_ratio(self, other: Box) -> Column:
        """Common area as a share of the smaller box; 0 where either has no area."""
        smaller = F.least(self.area, other.area)
        return F.when(self.intersects(other) & (smaller > 0), self.meet(other).area / F.nullif(smaller, F.lit(0.0))).otherwise(F.lit(0.0))

    def scaled(self, sx: Column | float, sy: Column | float) -> Box:
        return Box(self.x0 * sx, self.y0 * sy, self.x1 * sx, self.y1 * sy)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for c, n in ((self.x0, "x0"), (self.y0, "y0"), (self.x1, "x1"), (self.y1, "y1"))]


def points_to_pixels(box: Box, page_width: Column, page_height: Column, image_width: Column, image_height: Column) -> Box:
    return box.scaled(image_width / page_width, image_height / page_height)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a proper box, and rows whose box is inverted or has no edge."""
    good = F.coalesce(Box.named().valid, F.lit(False))
    return df.where(good), df.where(~good)


def cell_rects(rows: Column, cols: Column) -> Column:
    """The cells of a grid from its sorted boundaries: ``array<struct<row,col,x0,y0,x1,y1>>``."""

    def gaps(edges: Column) -> Column:
        return F.transform(
            F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0))), lambda e, i: F.struct(i.alias("i"), e.alias("a"), F.element_at(edges, i + 2).alias("b"))
        )

    return F.flatten(
        F.transform(
            gaps(rows),
            lambda r: F.transform(
                gaps(cols),
                lambda c: F.struct(
                    r["i"].alias("row"), c["i"].alias("col"), c["a"].alias("x0"), r["a"].alias("y0"), c["b"].alias("x1"), r["b"].alias("y1")
                ),
            ),
        )
    )


def boundary_count(edges: Column) -> Column:
    return F.greatest(F.size(edges) - 1, F.lit(0))
