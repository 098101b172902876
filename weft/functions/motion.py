"""Speed factors from novelty, stability, complexity and tracking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _between(low: float, share: Column) -> Column:
    return low + (1 - low) * share


def novelty_factor(novelty: Column, safe: float = 0.05, danger: float = 0.8, least: float = 0.10) -> Column:
    """1 up to safe, least from danger on, linear between."""
    return _between(least, 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (novelty - safe) / (danger - safe))))


def stability_factor(stability: Column, least: float = 0.25) -> Column:
    return _between(least, stability)


def complexity_factor(complexity: Column, reference: float = 2.0, sharpness: float = 3.0, least: float = 0.15) -> Column:
    """Falls exponentially with what complexity has above the reference."""
    return _between(least, F.exp(-sharpness * F.greatest(complexity - reference, F.lit(0.0)) / (reference + 1e-9)))


# Tracking states 2 ok, 1 not initialised, 3 lost; anything else is no image.
TRACKING = {2: 1.0, 1: 0.30, 3: 0.0}


def tracking_factor(state: Column) -> Column:
    out = F.lit(0.10)
    for code, factor in TRACKING.items():
        out = F.when(state == code, factor).otherwise(out)
    return out


def target_speed(v_min: Column, v_max: Column, v_crawl: Column, state: Column, *factors: Column) -> Column:
    """Speed within the band by the product of factors: 0 when lost, at most a crawl when not tracking well."""
    product = factors[0]
    for f in factors[1:]:
        product = product * f
    v = v_min + product * (v_max - v_min)
    return F.when(state == 3, 0.0).when(state != 2, F.least(v, v_crawl)).otherwise(v)
