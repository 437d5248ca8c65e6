"""Box algebra as Column expressions over x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + k) for k in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 when the union is empty."""
    inner = intersection(a, b)
    union = area(a) + area(b) - inner
    return F.when(union <= 0, F.lit(0.0)).otherwise(F.try_divide(inner, union))


def holds_centre(outer: Box, b: Box) -> Column:
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    return cx.between(outer[0], outer[2]) & cy.between(outer[1], outer[3])


def mergeable(a: Box, b: Box, overlap: float = 0.3, gap: int = 50) -> Column:
    """Halves of one drawing: overlapping in y by 30 % of the lower one, and at
    most 50 apart in x."""
    y = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    x = F.greatest(F.lit(0), F.greatest(a[0], b[0]) - F.least(a[2], b[2]))
    return (y / F.greatest(F.least(a[3] - a[1], b[3] - b[1]), F.lit(1)) >= overlap) & (x <= gap)


def padding(w: Column, h: Column) -> Column:
    """8 % of the mean side, from 15 to 50."""
    return F.greatest(F.lit(15), F.least(F.lit(50), ((w + h) / 2 * 0.08).cast("int")))


def is_structure_size(b: Box) -> Column:
    """Sides of 50 or more, at most five times as long as wide."""
    w, h = b[2] - b[0], b[3] - b[1]
    short, long = F.least(w, h), F.greatest(w, h)
    return (short >= 50) & (F.try_divide(long, short) <= 5)


def is_scheme(b: Box, page_width: Column, page_height: Column) -> Column:
    """A reaction scheme's crop: over 55 % of the width, 25 % of the height and
    20 % of the area of its page; false without a box."""
    w, h = F.try_divide(b[2] - b[0], page_width), F.try_divide(b[3] - b[1], page_height)
    return F.coalesce((w >= 0.55) & (h >= 0.25) & (w * h >= 0.20), F.lit(False))


def to_pixels(left: Column, top: Column, right: Column, bottom: Column, page_w: Column, page_h: Column, width: Column, height: Column, from_bottom: Column) -> Column:
    """A layout region in points as a clamped pixel box; null under 10 pixels."""
    sx, sy = width / page_w, height / page_h
    y1, y2 = F.when(from_bottom, page_h - top).otherwise(top), F.when(from_bottom, page_h - bottom).otherwise(bottom)
    x1p, x2p = F.least(left, right) * sx, F.greatest(left, right) * sx
    y1p, y2p = F.least(y1, y2) * sy, F.greatest(y1, y2) * sy
    clamp = lambda v, high: F.greatest(F.lit(0), F.least(high.cast("int"), v.cast("int")))
    made = F.struct(clamp(x1p, width).alias("x1"), clamp(y1p, height).alias("y1"), clamp(x2p, width).alias("x2"), clamp(y2p, height).alias("y2"))
    return F.when((made["x2"] - made["x1"] >= 10) & (made["y2"] - made["y1"] >= 10), made)


def region(b: Box, side: str, width: Column, height: Column, reach: int = 150) -> Column:
    """The neighbouring rectangle on a side of a box, clamped to the page; null
    under 20 pixels."""
    x1, y1, x2, y2 = b
    made = {"left": (x1 - reach, y1, x1, y2), "right": (x2, y1, x2 + reach, y2), "above": (x1, y1 - reach, x2, y1), "below": (x1, y2, x2, y2 + reach)}[side]
    c = [F.greatest(F.lit(0), F.least(v, edge)) for v, edge in zip(made, (width, height, width, height))]
    return F.when((c[2] - c[0] >= 20) & (c[3] - c[1] >= 20), F.struct(*[v.alias(n) for v, n in zip(c, ("x1", "y1", "x2", "y2"))]))


def progress(page: Column, pages: Column, at: Column, total: Column) -> Column:
    """Percentage done, at most 100."""
    inside = F.coalesce(F.try_divide(at, total), F.lit(0.0))
    return F.least(F.lit(100.0), F.coalesce(F.try_divide(page - 1 + inside, pages), F.lit(0.0)) * 100)
