"""Novelty of an observation as a weighted soft OR of signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column, scale: float = 1.0) -> Column:
    """Centred at zero on purpose: no change still counts one half; an absent signal is null and counts nothing."""
    return 1 / (1 + F.exp(-x / max(scale, 1e-9)))


def status_signal(status: Column) -> Column:
    return F.when(status == "unknown", 1.0).when(status == "uncertain", 0.5).otherwise(0.0)


def soft_or(signals: list[Column], weights: list[float] | None = None) -> Column:
    """1 - product of (1 - weight * signal); a null signal is no evidence."""
    weights = weights or [1.0] * len(signals)
    return 1 - reduce(lambda a, b: a * b, [1 - w * F.coalesce(s, F.lit(0.0)) for s, w in zip(signals, weights)])


def spectral_signal(d_entropy: Column, d_lambda: Column, d_beta: Column, present: Column) -> Column:
    """Soft OR of the three spectral changes; 0 if there is no spectral context, zeros for absent changes within one."""
    zero = F.lit(0.0)
    combined = soft_or([sigmoid(F.coalesce(d_entropy, zero), 0.25), sigmoid(F.coalesce(d_lambda, zero), 0.25), sigmoid(F.abs(F.coalesce(d_beta, zero)), 1.0)])
    return F.when(present, combined).otherwise(0.0)


def leakage_signal(d_t: Column, delta: Column) -> Column:
    """How far |d_t| is off |delta|, relative to it; 0 without both or with a delta next to nothing."""
    known = d_t.isNotNull() & delta.isNotNull() & (F.abs(delta) >= 1e-9)
    return F.when(known, sigmoid(F.abs(F.abs(d_t) - F.abs(delta)) / F.abs(delta), 0.5)).otherwise(0.0)


def worth_asking(score: Column, area: Column, least_score: float = 0.5, least_area: float = 200.0) -> Column:
    return (score >= least_score) & (area >= least_area)


def information_gain(score: Column, area: Column) -> Column:
    """Score times log(1 + area), areas of at least one."""
    return score * F.log1p(F.greatest(area, F.lit(1.0)))
