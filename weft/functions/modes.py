"""Columns over spectral modes: weights h and reference weights h0 of each mode."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def geometric(h: Column, h0: Column) -> Column:
    return -F.ln(h / h0) - 1


def vacuum(h0: Column) -> Column:
    """Fixed point without a source."""
    return h0 * math.exp(-1)


def log_linear(a: Column, b: Column, t: Column | float) -> Column:
    """Geodesic exp(a + b t)."""
    return F.exp(a + b * t)


def heat_weight(eigenvalue: Column, t: float) -> Column:
    return F.exp(-eigenvalue * t)


def mode_information(h: Column, noise: float = 1.0, weight: Column | float = 1.0) -> Column:
    return F.log1p(h / noise) * weight / 2


def source(h: Column, strength: float = 1.0, noise: float = 1.0, weight: Column | float = 1.0) -> Column:
    """Strength times the first derivative of the mode's information."""
    return strength * weight / (2 * (noise + h))


def source_slope(h: Column, strength: float = 1.0, noise: float = 1.0, weight: Column | float = 1.0) -> Column:
    return -strength * weight / (2 * (noise + h) * (noise + h))


def residual(h: Column, h0: Column, **kw) -> Column:
    """Zero at a self-consistent kernel."""
    return geometric(h, h0) - source(h, **kw)


def margin(h: Column, **kw) -> Column:
    """Positive where the fixed point is stable."""
    return source_slope(h, **kw) + 1 / h


def fixed_point(h0: Column, strength: float = 1.0, noise: float = 1.0, rounds: int = 40) -> Column:
    """h of h = h0 exp(-1 - source(h)), by a fold of fixed rounds over one mode; it contracts for every positive h0."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), vacuum(h0), lambda h, _: h0 * F.exp(-1 - source(h, strength, noise)))


def path_eigenvalue(mode: Column, n: Column) -> Column:
    """Laplacian eigenvalue of a path graph of n nodes."""
    return 2 * (1 - F.cos(math.pi * mode / n))
