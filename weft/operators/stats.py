"""Aggregates: robust and weighted moments, contrasts, covariance kernels, fits and counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.tables import dimension


def stage_summary(rows: DataFrame, stage: str, value: str) -> DataFrame:
    """stage, n, mean, std (0 for one value), median."""
    return rows.where(f"{stage} is not null and {value} is not null").groupBy(stage).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.when(F.count("*") > 1, F.stddev_samp(value)).otherwise(0.0).alias("std"), F.median(value).alias("median"))


def welch_contrast(rows: DataFrame, stage: str, value: str) -> DataFrame:
    """a, b, delta, cohens_d, t, df of each pair of stages a < b; null where a stage has fewer than two values.

    Stages are categories, one row each after aggregation, so pairs are made of those rows.
    """
    each = rows.where(f"{stage} is not null and {value} is not null").groupBy(stage).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    a, b = (each.select(F.col(stage).alias(s), F.col("n").cast("double").alias(f"n{s}"), F.col("m").alias(f"m{s}"), F.col("v").alias(f"v{s}")) for s in "ab")
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    ok = (F.col("na") >= 2) & (F.col("nb") >= 2)
    delta = F.col("ma") - F.col("mb")
    pooled = F.sqrt(((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / (F.col("na") + F.col("nb") - 2))
    return a.join(b, F.col("a") < F.col("b")).select(
        "a", "b", F.when(ok, delta).alias("delta"), F.when(ok & (pooled > 0), delta / pooled).alias("cohens_d"), F.when(ok & (ea + eb > 0), delta / F.sqrt(ea + eb)).alias("t"),
        F.when(ok & (ea + eb > 0), F.pow(ea + eb, 2) / (ea * ea / (F.col("na") - 1) + eb * eb / (F.col("nb") - 1))).alias("df"),
    )


def weighted_moments(rows: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    """keys, n, weight, mean, variance (over weight - 1, 0 below two values), low, high.

    Unknown values and weights that aren't positive are skipped. The sums are taken about each
    key's own minimum, which is exact to merge and keeps large offsets out of the squares.
    """
    known = rows.select(*keys, value.cast("double").alias("x"), weight.cast("double").alias("w")).where("x is not null and not isnan(x) and w > 0 and abs(x) < double('infinity')")
    base = known.groupBy(*keys).agg(F.min("x").alias("x0"))
    d = F.col("x") - F.col("x0")
    sums = known.join(base, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.sum(F.col("w") * d).alias("s"), F.sum(F.col("w") * d * d).alias("q"), F.min("x").alias("low"), F.max("x").alias("high"), F.first("x0").alias("x0"))
    return sums.select(*keys, "n", "weight", (F.col("x0") + F.col("s") / F.col("weight")).alias("mean"), F.when(F.col("n") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("weight")) / F.greatest(F.col("weight") - 1, F.lit(1e-12)))).alias("variance"), "low", "high")


def merge_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the union of disjoint stores: keys, n, weight, mean, m2."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), (F.sum(F.col("weight") * F.col("mean")) / F.sum("weight")).alias("mean"), (F.sum(F.col("m2") + F.col("weight") * F.col("mean") * F.col("mean")) - F.pow(F.sum(F.col("weight") * F.col("mean")), 2) / F.sum("weight")).alias("m2"))


def packing_confidence(moments: DataFrame, owner: str, least: int = 1) -> DataFrame:
    """owner, properties (with enough samples), observations (median count), confidence (1 - mean relative scatter, 1 if unknown)."""
    relative = F.when(F.col("n") >= 2, F.least(F.sqrt("variance") / F.greatest(F.abs("mean"), F.lit(1e-3)), F.lit(1.0)))
    return moments.groupBy(owner).agg(F.count(F.when(F.col("n") >= least, 1)).alias("properties"), F.median(F.when(F.col("n") > 0, F.col("n").cast("double"))).alias("observations"), F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.avg(relative))), F.lit(1.0)).alias("confidence"))


def window_covariance(rows: DataFrame, window: Column, t: str, channel: str, value: str) -> DataFrame:
    """win, a, b, cov: unbiased covariance of z-scored channels a <= b over the times that both have in each window."""
    known = rows.where(f"{value} is not null").select(window.alias("win"), F.col(t).alias("t"), F.col(channel).alias("c"), F.col(value).cast("double").alias("x"))
    scale = known.groupBy("c").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = known.join(scale, "c").select("win", "t", "c", ((F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("z"))
    a, b = z.select("win", "t", F.col("c").alias("a"), F.col("z").alias("za")), z.select("win", "t", F.col("c").alias("b"), F.col("z").alias("zb"))
    return a.join(b, ["win", "t"]).where("a <= b").groupBy("win", "a", "b").agg(F.covar_samp("za", "zb").alias("cov"))


def log_linear_fit(rows: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """keys, n, rate (minus the slope of ln y over x), r2, of positive y only; null below two points."""
    known = rows.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y")).where("x is not null and y > 0")
    return known.groupBy(*keys).agg(F.count("*").alias("n"), (-F.regr_slope(F.ln("y"), F.col("x"))).alias("rate"), F.regr_r2(F.ln("y"), F.col("x")).alias("r2"))


def power_law_fit(rows: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """keys, n, exponent: slope of ln y over ln x, of positive values."""
    known = rows.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y")).where("x > 0 and y > 0")
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(F.ln("y"), F.ln("x")).alias("exponent"))


def evidence_counts(evidence: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """source, label, cat, n: weighted counts of evidence in the vocabulary; unknown sources and labels drop out."""
    return evidence.join(vocabulary.select("source", "label").distinct(), ["source", "label"]).groupBy("source", "label", "cat").agg(F.sum("w").alias("n"))


def dirichlet_refit(prior: DataFrame, counts: DataFrame, alpha: float = 10.0) -> DataFrame:
    """source, label, cat, q: (alpha prior + n) over its sum in each source and category; an empty column stays 0."""
    w = Window.partitionBy("source", "cat")
    pseudo = prior.join(counts, ["source", "label", "cat"], "left").withColumn("pseudo", alpha * F.col("q") + F.coalesce("n", F.lit(0.0)))
    return pseudo.select("source", "label", "cat", (F.col("pseudo") / F.when(F.sum("pseudo").over(w) > 0, F.sum("pseudo").over(w)).otherwise(1.0)).alias("q"))


def top_spectrum(rows: DataFrame, group: str, item: str, value: Column, k: int) -> DataFrame:
    """group, rank, share: the k largest positive values of each group, normalised to sum 1."""
    sums = rows.groupBy(group, item).agg(F.sum(value).alias("v")).where("v > 0")
    w = Window.partitionBy(group)
    top = sums.withColumn("rank", F.row_number().over(w.orderBy(F.desc("v"), item))).where(F.col("rank") <= k)
    return top.select(group, "rank", (F.col("v") / F.sum("v").over(w)).alias("share"))


def spectrum_distances(spectra: DataFrame, group: str) -> DataFrame:
    """a, b, tv: total variation of the spectra of each pair of groups a < b, ranks that one lacks counting as zero.

    Sum of |p - q| is 2 - 2 sum min(p, q) for shares that sum to one, so an inner join on rank does.
    """
    a, b = (spectra.select(F.col(group).alias(s), "rank", F.col("share").alias(f"p{s}")) for s in "ab")
    return a.join(b, "rank").where("a < b").groupBy("a", "b").agg(F.greatest(1 - F.sum(F.least("pa", "pb")), F.lit(0.0)).alias("tv"))


def autoregression(rows: DataFrame, key: str, t: str | list[str], values: list[str], dt: float, ridge: float = 0.0) -> DataFrame:
    """key, n, drift: row-major matrix (M - I) / dt of the least-squares map x(t+1) = M x(t), by sums of products and one small solve.

    drift is an array of d*d numbers, null where the map isn't determined.
    """
    d = len(values)
    order = [t] if isinstance(t, str) else t
    w = Window.partitionBy(key).orderBy(*order)
    ahead = rows.dropna(subset=[key, *order, *values]).select(key, *(F.col(v).cast("double").alias(f"x{i}") for i, v in enumerate(values)), *(F.lead(F.col(v).cast("double")).over(w).alias(f"y{i}") for i, v in enumerate(values))).where("y0 is not null")
    gram = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(d) for j in range(d)]
    cross = [F.sum(F.col(f"y{i}") * F.col(f"x{j}")).alias(f"c{i}_{j}") for i in range(d) for j in range(d)]
    sums = ahead.groupBy(key).agg(F.count("*").alias("n"), *gram, *cross).select(key, "n", F.array(*(f"g{i}_{j}" for i in range(d) for j in range(d))).alias("g"), F.array(*(f"c{i}_{j}" for i in range(d) for j in range(d))).alias("c"))

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(g, c):
            m = np.reshape(a, (d, d)) + ridge * np.eye(d)
            out.append(None if np.linalg.matrix_rank(m) < d else list(((np.reshape(b, (d, d)) @ np.linalg.inv(m) - np.eye(d)) / dt).ravel()))
        return pd.Series(out)

    return sums.select(key, "n", solve("g", "c").alias("drift"))


def label_distribution(rows: DataFrame, key: str, label: str, weight: Column, vocabulary: DataFrame | None = None) -> DataFrame:
    """key, label, p: weighted share of each label; with a vocabulary (label) only its labels count, and each key has all of them, at 0 too."""
    if vocabulary is not None:
        names = vocabulary.select(F.col("label").alias(label)).distinct()
        every = rows.where(f"{key} is not null").select(key).distinct().join(dimension(names))
        held = every.join(rows.groupBy(key, label).agg(F.sum(weight).alias("_w")), [key, label], "left")
        return label_distribution(held, key, label, F.coalesce("_w", F.lit(0.0)))
    w = Window.partitionBy(key)
    sums = rows.where(f"{key} is not null and {label} is not null").groupBy(key, label).agg(F.sum(weight).alias("w"))
    return sums.select(key, label, F.when(F.sum("w").over(w) > 0, F.col("w") / F.sum("w").over(w)).otherwise(0.0).alias("p"))


def logsumexp(rows: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """keys, lse: log of the sum of exponentials, taken about each key's maximum."""
    known = rows.select(*keys, x.cast("double").alias("x")).where("x is not null and not isnan(x)")
    top = known.groupBy(*keys).agg(F.max("x").alias("top"))
    return known.join(top, keys).groupBy(*keys).agg((F.ln(F.sum(F.exp(F.col("x") - F.col("top")))) + F.first("top")).alias("lse"))


def reward(rows: DataFrame, key: str, complexity: Column, visits: Column, weight: float = 0.7) -> DataFrame:
    """key, reward: max-normalised blend of complexity and the inverse of visits, scaled to at most one."""
    eps = 1e-8
    base = rows.select(key, complexity.alias("c"), (1 / (1 + visits)).alias("v"))
    tops = base.agg(F.max("c").alias("mc"), F.max("v").alias("mv"))
    blend = base.join(F.broadcast(tops)).select(key, (weight * F.col("c") / (F.col("mc") + eps) + (1 - weight) * F.col("v") / (F.col("mv") + eps)).alias("r"))
    return blend.join(F.broadcast(blend.agg(F.max("r").alias("m")))).select(key, (F.col("r") / (F.col("m") + eps)).alias("reward"))


def driven_autoregression(rows: DataFrame, key: str, order: list[str], values: list[str], inputs: list[str], dt: float, ridge: float = 1e-8) -> DataFrame:
    """key, n, drift, gain: (M - I) / dt and G / dt of the least-squares map x(t+1) = M x(t) + G u(t), as arrays row by row, by sums of products and one small solve."""
    d, m = len(values), len(inputs)
    w = Window.partitionBy(key).orderBy(*order)
    known = rows.dropna(subset=[key, *order, *values, *inputs])
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate([*values, *inputs])]
    ahead = known.select(key, *x, *(F.lead(F.col(c).cast("double")).over(w).alias(f"y{i}") for i, c in enumerate(values))).where("y0 is not null")
    gram = F.array(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(d + m) for j in range(d + m)))
    cross = F.array(*(F.sum(F.col(f"y{i}") * F.col(f"x{j}")) for i in range(d) for j in range(d + m)))
    sums = ahead.groupBy(key).agg(F.count("*").alias("n"), gram.alias("g"), cross.alias("c"))

    @F.pandas_udf("struct<drift:array<double>,gain:array<double>>")
    def solve(g: pd.Series, c: pd.Series) -> pd.DataFrame:
        drift, gain = [], []
        for a, b in zip(g, c):
            theta = np.linalg.solve(np.reshape(a, (d + m, d + m)) + ridge * np.eye(d + m), np.reshape(b, (d, d + m)).T).T
            drift.append(((theta[:, :d] - np.eye(d)) / dt).ravel().tolist()), gain.append((theta[:, d:] / dt).ravel().tolist())
        return pd.DataFrame({"drift": drift, "gain": gain})

    return sums.select(key, "n", solve("g", "c").alias("s")).select(key, "n", "s.drift", "s.gain")


class Moments:
    """Update, merge and finish of weighted moments, as expressions: what any other aggregate of this shape offers."""

    @staticmethod
    def update(value: Column, weight: Column) -> list[Column]:
        """Aggregates of a group's rows: n, weight, mean, m2."""
        w, wx, wxx = F.sum(weight), F.sum(weight * value), F.sum(weight * value * value)
        return [F.count(value).alias("n"), w.alias("weight"), (wx / w).alias("mean"), F.greatest(F.lit(0.0), wxx - wx * wx / w).alias("m2")]

    @staticmethod
    def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
        return merge_moments(parts, keys)

    @staticmethod
    def finish() -> list[Column]:
        """Columns of merged rows: mean, variance (0 below two values)."""
        return [F.col("mean"), F.when(F.col("n") < 2, 0.0).otherwise(F.col("m2") / F.greatest(F.col("weight") - 1, F.lit(1e-12))).alias("variance")]


def sliding_covariance(rows: DataFrame, key: str, order: str, channel: str, value: str, width: int, stride: int) -> DataFrame:
    """key, win, a, b, cov: unbiased covariance of channels a <= b, each divided by its own overall scatter, in windows of `width` samples a `stride` apart, means taken out in each; incomplete windows are left out.

    rows: one value for each key, order and channel. A sample's place is its rank among the key's distinct orders.
    """
    from weft.operators.trajectory import sample_windows

    known = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    scale = known.groupBy(key, channel).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = known.join(scale, [key, channel]).select(key, order, F.col(channel).alias("c"), ((F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).alias("z"))
    wide = z.groupBy(key, order).agg(F.map_from_entries(F.collect_list(F.struct("c", "z"))).alias("z"))
    held = sample_windows(wide, key, order, width, stride)
    cells = held.select(key, "win", F.explode("z").alias("a", "za"), "z").select(key, "win", "a", "za", F.explode("z").alias("b", "zb")).where("a <= b")
    return cells.groupBy(key, "win", "a", "b").agg(F.covar_samp("za", "zb").alias("cov"))
