"""Boxes as flat integer columns x1, y1, x2, y2, with an optional prefix."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CORNERS = ("x1", "y1", "x2", "y2")


class Box:
    """Column expressions of a box; ``prefix`` is put before the corner names."""

    def __init__(self, prefix: str = "", columns: tuple[Column, ...] | None = None) -> None:
        self.x1, self.y1, self.x2, self.y2 = columns or tuple(F.col(prefix + c) for c in CORNERS)

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def cx(self) -> Column:
        return (self.x1 + self.x2) / 2.0

    @property
    def cy(self) -> Column:
        return (self.y1 + self.y2) / 2.0

    @property
    def valid(self) -> Column:
        return (self.x1 >= 0) & (self.y1 >= 0) & (self.x2 > self.x1) & (self.y2 > self.y1)

    def expanded(self, pad_x, pad_y, width, height) -> Box:
        """Padded and clamped to a page; may be degenerate, see ``valid``."""
        return Box(columns=(F.greatest(F.lit(0), self.x1 - pad_x), F.greatest(F.lit(0), self.y1 - pad_y), F.least(F.lit(width), self.x2 + pad_x), F.least(F.lit(height), self.y2 + pad_y)))

    def struct(self) -> Column:
        return F.struct(*[getattr(self, c).alias(c) for c in CORNERS])

    def flat(self, prefix: str = "") -> list[Column]:
        return [getattr(self, c).cast("int").alias(prefix + c) for c in CORNERS]


def intersection_area(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Box, b: Box) -> Column:
    both = intersection_area(a, b)
    return both / F.greatest(a.area + b.area - both, F.lit(1))


def contains_centre(outer: Box, inner: Box) -> Column:
    return inner.cx.between(outer.x1, outer.x2) & inner.cy.between(outer.y1, outer.y2)


def belongs(item: Box, region: Box, least: float = 0.35) -> Column:
    """An item belongs to a region that has its centre, or enough of its area."""
    return contains_centre(region, item) | (intersection_area(item, region) / F.greatest(item.area, F.lit(1)) >= least)


def union_box() -> list[Column]:
    """Aggregates: the smallest box around all."""
    return [F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")]


def polygon_box(points: Column) -> Box:
    """The integer box of an array of [x, y] points, or of one [x1, y1, x2, y2]: rounded half to even, at least 1 wide and high."""
    flat = F.size(F.get(points, F.lit(0))) == 4
    xs = F.when(flat, F.array(points[0][0], points[0][2])).otherwise(F.transform(points, lambda p: p[0]))
    ys = F.when(flat, F.array(points[0][1], points[0][3])).otherwise(F.transform(points, lambda p: p[1]))
    low = lambda v: F.greatest(F.lit(0), F.bround(F.array_min(v), 0).cast("int"))
    x1, y1 = low(xs), low(ys)
    return Box(columns=(x1, y1, F.greatest(x1 + 1, F.bround(F.array_max(xs), 0).cast("int")), F.greatest(y1 + 1, F.bround(F.array_max(ys), 0).cast("int"))))


def crop_to_page(item: Box, crop: Box) -> Box:
    """A box in crop pixels, clamped to the crop, in page pixels; at least 1 wide and high."""
    x1 = F.least(F.greatest(item.x1, F.lit(0)), crop.width - 1)
    y1 = F.least(F.greatest(item.y1, F.lit(0)), crop.height - 1)
    x2 = F.least(F.greatest(item.x2, x1 + 1), crop.width)
    y2 = F.least(F.greatest(item.y2, y1 + 1), crop.height)
    return Box(columns=(x1 + crop.x1, y1 + crop.y1, x2 + crop.x1, y2 + crop.y1))


def upscaled_to_page(item: Box, crop: Box, scale: Column) -> Box:
    """A box on an upscaled crop, in page pixels."""
    down = lambda v: F.bround(v / scale, 0).cast("int")
    return crop_to_page(Box(columns=tuple(down(getattr(item, c)) for c in CORNERS)), crop)
