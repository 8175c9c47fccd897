"""Bounding-box algebra on ``array<float>`` columns, in single precision where it matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_float(c: Column) -> Column:
    return c.cast("float")


def four_or_null(bbox: Column) -> Column:
    """Any number of coordinates but four gives null."""
    return F.when(F.size(bbox) == 4, bbox)


def corner(bbox: Column, i: int) -> Column:
    """Integer corner ``i``, truncated towards zero, 0 when absent."""
    return F.coalesce(F.get(bbox, F.lit(i)).try_cast("int"), F.lit(0))


def union(boxes: Column) -> Column:
    """Smallest box around a list of boxes; an empty or null list gives zeros."""
    def edge(i: int) -> Column:
        return F.transform(boxes, lambda b: F.get(b, F.lit(i)))
    zero = F.array(*[as_float(F.lit(0.0))] * 4)
    return F.when(F.size(F.coalesce(boxes, F.array())) > 0, F.array(
        F.array_min(edge(0)), F.array_min(edge(1)), F.array_max(edge(2)), F.array_max(edge(3)),
    )).otherwise(zero)


def _clamped(bbox: Column, width: Column, height: Column, scale) -> Column:
    # The near corner is clamped from below only, the far corner from above only.
    zero, w, h = as_float(F.lit(0.0)), as_float(width), as_float(height)
    return F.array(
        F.greatest(zero, scale(F.get(bbox, F.lit(0)), w)),
        F.greatest(zero, scale(F.get(bbox, F.lit(1)), h)),
        F.least(w, scale(F.get(bbox, F.lit(2)), w)),
        F.least(h, scale(F.get(bbox, F.lit(3)), h)),
    )


def scale_1024(bbox: Column, width: Column, height: Column) -> Column:
    """0..1024 coordinates to pixels; null unless there are four."""
    return F.when(F.size(bbox) == 4, _clamped(
        bbox, width, height, lambda v, side: as_float(v * as_float(side / F.lit(1024)))))


def scale_999(bbox: Column, width: Column, height: Column) -> Column:
    """0..999 coordinates to pixels; zeros unless there are four."""
    zero = F.array(*[as_float(F.lit(0.0))] * 4)
    return F.when(F.size(bbox) == 4, _clamped(
        bbox, width, height, lambda v, side: as_float(as_float(v / F.lit(999)) * side))
    ).otherwise(zero)


def scale_by(bbox: Column, sx: Column, sy: Column) -> Column:
    """Multiply integer coordinates by (sx, sy) and truncate; other lengths pass unchanged."""
    scaled = F.transform(bbox, lambda v, i: (v * F.when(i % 2 == 0, sx).otherwise(sy)).try_cast("int"))
    return F.when(F.size(bbox) == 4, scaled).otherwise(bbox)
