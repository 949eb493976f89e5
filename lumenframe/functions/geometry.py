"""Boxes as arrays of x, y, width, height in shares of the frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of box comparison and clean-up.
SAME_IOU, SAME_CONTAINMENT, SAME_AREA_RATIO = 0.55, 0.8, 3.0
MIN_AREA, MAX_AREA, CONTEXT = 0.0002, 0.8, 1.5


def area(b: Column) -> Column:
    return b[2] * b[3]


def _overlap(a: Column, b: Column) -> Column:
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - _overlap(a, b)
    return F.when(union > 0, _overlap(a, b) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of ``a`` that lies inside ``b``."""
    return F.when(area(a) > 0, _overlap(a, b) / area(a)).otherwise(F.lit(0.0))


def same_instance(a: Column, b: Column) -> Column:
    """Much overlap, or one inside the other at similar size."""
    small, large = F.least(area(a), area(b)), F.greatest(area(a), area(b))
    inside = F.when(small > 0, _overlap(a, b) / small).otherwise(F.lit(0.0)) >= SAME_CONTAINMENT
    return (iou(a, b) >= SAME_IOU) | ((small > 0) & (large <= SAME_AREA_RATIO * small) & inside)


def valid(b: Column) -> Column:
    """Corner inside the frame, positive size."""
    return (F.size(b) == 4) & b[0].between(0, 1) & b[1].between(0, 1) & (b[2] > 0) & (b[3] > 0)


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Left, top, right, bottom in pixels, rounded half to even, one pixel at least."""
    left, top = F.bround(b[0] * width).cast("long"), F.bround(b[1] * height).cast("long")
    right = F.least(width.cast("long"), F.bround((b[0] + b[2]) * width).cast("long"))
    bottom = F.least(height.cast("long"), F.bround((b[1] + b[3]) * height).cast("long"))
    return F.array(left, top, F.greatest(right, left + 1), F.greatest(bottom, top + 1))


def with_context(b: Column, grow: float = CONTEXT) -> Column:
    """The box grown about its centre, at most to the frame's size, and moved inside it."""
    w, h = F.least(b[2] * grow, F.lit(1.0)), F.least(b[3] * grow, F.lit(1.0))
    x = F.least(F.greatest(b[0] + b[2] / 2 - w / 2, F.lit(0.0)), 1 - w)
    y = F.least(F.greatest(b[1] + b[3] / 2 - h / 2, F.lit(0.0)), 1 - h)
    return F.array(x, y, w, h)


def map_into(b: Column, tile: Column) -> Column:
    """A box of a tile in the coordinates of the tile's frame."""
    return F.array(tile[0] + b[0] * tile[2], tile[1] + b[1] * tile[3], b[2] * tile[2], b[3] * tile[3])


def from_pixels(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Pixel corners as a box."""
    return F.array(left / width, top / height, (right - left) / width, (bottom - top) / height)


def plausible(b: Column, general: bool = True) -> Column:
    """Not too small; a general proposal isn't nearly the whole frame either."""
    return (area(b) >= MIN_AREA) & ((area(b) <= MAX_AREA) if general else F.lit(True))


def relation(name: str, a: Column, b: Column, near: float = 0.2) -> Column:
    """Geometric predicates between two boxes of one frame."""
    ax, ay, bx, by = a[0] + a[2] / 2, a[1] + a[3] / 2, b[0] + b[2] / 2, b[1] + b[3] / 2
    return {
        "inside": containment(a, b) >= SAME_CONTAINMENT,
        "left_of": ax < bx,
        "right_of": ax > bx,
        "above": ay < by,
        "below": ay > by,
        "near": F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) <= near,
    }[name]
