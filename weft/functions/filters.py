"""Predicates on places and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_box(x: Column, y: Column, box: tuple[float, float, float, float], margin: float = 0.0) -> Column:
    """Whether a point lies in (x1, y1, x2, y2) widened by a margin, both ends included; null coordinates lie nowhere."""
    x1, y1, x2, y2 = box
    return F.coalesce(x.between(x1 - margin, x2 + margin) & y.between(y1 - margin, y2 + margin), F.lit(False))


def in_region(lat: Column, lon: Column, size: Column, lats: tuple | None = None, lons: tuple | None = None, sizes: tuple | None = None) -> Column:
    """Whether latitude, longitude and size lie in the given bounds, ends included; bounds that are None don't matter."""
    held = F.lit(True)
    for column, bounds in ((lat, lats), (lon, lons), (size, sizes)):
        if bounds is not None:
            held = held & column.between(*bounds)
    return F.coalesce(held, F.lit(False))
