"""Boxes, intervals and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in BOX]


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes; 0 for a missing box or an empty union. Negative extents count as 0."""
    zero = F.lit(0.0)
    area = lambda x1, y1, x2, y2: F.greatest(x2 - x1, zero) * F.greatest(y2 - y1, zero)
    inter = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def range_iou(a0, a1, b0, b1) -> Column:
    """Overlap over span of two closed ranges without counting end points: single frames score 0."""
    a0, a1, b0, b1 = map(_col, (a0, a1, b0, b1))
    inter = F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def aspect(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = map(_col, (x1, y1, x2, y2))
    return F.when(y2 - y1 > 0, (x2 - x1) / (y2 - y1)).otherwise(0.0)


def area(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    return (_col(x2) - _col(x1)) * (_col(y2) - _col(y1))


def dot(a: str, b: str) -> Column:
    """Inner product of two float arrays in double precision; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def temporal_bonus(a0, a1, b0, b1) -> Column:
    """Up to 0.15 for intervals whose nearest end points are under 300 seconds apart."""
    a0, a1, b0, b1 = map(_col, (a0, a1, b0, b1))
    gap = F.least(F.abs(a0 - b0), F.abs(a0 - b1), F.abs(a1 - b0), F.abs(a1 - b1))
    return F.when(gap < 300, 0.15 * (1 - gap / 300)).otherwise(0.0)


def normalised(vector: str) -> Column:
    """A vector at unit length, in double; one of length 0 stays."""
    return F.expr(f"transform(transform({vector}, x -> cast(x as double)), x -> x / coalesce(nullif(sqrt(aggregate({vector}, 0D, (a, y) -> a + cast(y as double) * cast(y as double))), 0D), 1D))")
