"""Vegetation indices; 0 where the denominator is next to nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(a + b > 1e-6, (a - b) / (a + b)).otherwise(0.0)


def ndvi(nir: Column, red: Column) -> Column:
    return _ratio(nir, red)


def ndre(nir: Column, red_edge: Column) -> Column:
    return _ratio(nir, red_edge)


def gndvi(nir: Column, green: Column) -> Column:
    return _ratio(nir, green)


def evi(nir: Column, red: Column, blue: Column, soil: float = 1.0) -> Column:
    # The index's published coefficients 2.5, 6 and 7.5.
    below = nir + 6.0 * red - 7.5 * blue + soil
    return F.when(F.abs(below) > 1e-6, 2.5 * (nir - red) / below).otherwise(0.0)
