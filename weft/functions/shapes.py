"""Plane geometry on boxes and rings, and superquadric solids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_iou(a: Column, b: Column) -> Column:
    """Overlap over union of two boxes with x1, y1, x2, y2; 0 if the union is empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def _edges(ring: Column) -> Column:
    """Consecutive vertices, the last with the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def ring_area(ring: Column, x: str = "x", y: str = "y") -> Column:
    """Shoelace area, without sign; 0 for fewer than three vertices."""
    total = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["p"][x] * e["q"][y] - e["q"][x] * e["p"][y])
    return F.when(F.size(ring) >= 3, F.abs(total) / 2).otherwise(0.0)


def in_ring(px: Column, py: Column, ring: Column, x: str = "x", y: str = "y") -> Column:
    """Ray casting: an odd number of edges is crossed."""
    crossed = lambda e: ((e["p"][y] > py) != (e["q"][y] > py)) & (px < (e["q"][x] - e["p"][x]) * (py - e["p"][y]) / F.nullif(e["q"][y] - e["p"][y], F.lit(0.0)) + e["p"][x])
    return F.size(F.filter(_edges(ring), lambda e: F.coalesce(crossed(e), F.lit(False)))) % 2 == 1


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment; a segment of no length is a point."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / square)))
    return F.sqrt(F.pow(px - x1 - t * dx, 2) + F.pow(py - y1 - t * dy, 2))


def solid_inside_outside(x: Column, y: Column, z: Column, scale: tuple, shape: tuple) -> Column:
    """Below 1 inside a superquadric in its own frame, 1 on it, above 1 outside."""
    (a, b, c), (e1, e2) = scale, shape
    flat = F.pow(F.pow(F.abs(x / a), 2 / e2) + F.pow(F.abs(y / b), 2 / e2), e2 / e1)
    return flat + F.pow(F.abs(z / c), 2 / e1)


def solid_signed_distance(x: Column, y: Column, z: Column, scale: tuple, shape: tuple) -> Column:
    """Radial distance from the surface, negative inside."""
    f = solid_inside_outside(x, y, z, scale, shape)
    return F.sqrt(x * x + y * y + z * z) * (1 - F.pow(F.greatest(f, F.lit(1e-12)), -shape[0] / 2))


def solid_volume(scale: tuple, shape: tuple) -> float:
    """Closed form with beta functions."""
    (a, b, c), (e1, e2) = scale, shape
    beta = lambda p, q: math.exp(math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q))
    return 2 * a * b * c * e1 * e2 * beta(e1 / 2 + 1, e1) * beta(e2 / 2, e2 / 2)


def solid_box(centre: Column, scale: Column, rotation: Column) -> Column:
    """Struct low, high: the box along the axes around a turned solid's own box; half its sides are |R| times the scale."""
    half = [sum((F.abs(rotation[3 * i + j]) * scale[j] for j in range(1, 3)), F.abs(rotation[3 * i]) * scale[0]) for i in range(3)]
    return F.struct(F.array(*(centre[i] - half[i] for i in range(3))).alias("low"), F.array(*(centre[i] + half[i] for i in range(3))).alias("high"))
