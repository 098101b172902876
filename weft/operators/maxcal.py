"""Least-biased distributions under constraints on means.

The dual log Z + lambda . F with gradient F - <f> is minimised by Newton steps. Each step
is one aggregate over the rows that returns the log partition function, the means and
the second moments of the features: C + C^2 + 1 numbers for C constraints.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.tables import forget, keep


def _moments(rows: DataFrame, lam: np.ndarray, c: int) -> tuple[float, np.ndarray, np.ndarray]:
    x = F.col("lq")
    for i in range(c):
        x = x - float(lam[i]) * F.col(f"f{i}")
    top = rows.agg(F.max(x)).first()[0]
    e = F.exp(x - top)
    out = rows.agg(F.sum(e).alias("z"), *(F.sum(e * F.col(f"f{i}")).alias(f"m{i}") for i in range(c)), *(F.sum(e * F.col(f"f{i}") * F.col(f"f{j}")).alias(f"s{i}_{j}") for i in range(c) for j in range(c))).first()
    z = out["z"]
    mean = np.array([out[f"m{i}"] / z for i in range(c)])
    second = np.array([[out[f"s{i}_{j}"] / z for j in range(c)] for i in range(c)])
    return math.log(z) + top, mean, second - np.outer(mean, mean)


def fit(rows: DataFrame, features: list[Column], targets: list[float], log_q: Column | None = None, rounds: int = 50, tol: float = 1e-10) -> np.ndarray:
    """Multipliers for which the means of the features meet the targets. Raises if a target can't be met."""
    c = len(features)
    flat = rows.select((F.lit(0.0) if log_q is None else log_q).alias("lq"), *(f.cast("double").alias(f"f{i}") for i, f in enumerate(features))).dropna()
    flat = keep(flat)
    try:
        ends = flat.agg(*(F.min(f"f{i}").alias(f"a{i}") for i in range(c)), *(F.max(f"f{i}").alias(f"b{i}") for i in range(c))).first()
        for i, t in enumerate(targets):
            if ends[f"a{i}"] is None or not ends[f"a{i}"] <= t <= ends[f"b{i}"]:
                raise ValueError(f"target {t} lies outside the range of feature {i}")
        lam, goal = np.zeros(c), np.array(targets, float)
        log_z, mean, cov = _moments(flat, lam, c)
        for _ in range(rounds):
            gap = goal - mean
            if np.abs(gap).max() < tol:
                break
            direction = -np.linalg.solve(cov + 1e-12 * np.trace(cov) * np.eye(c) + 1e-300 * np.eye(c), gap)
            value, size = log_z + lam @ goal, 1.0
            while True:
                trial = lam + size * direction
                log_z, mean, cov = _moments(flat, trial, c)
                if log_z + trial @ goal <= value + 1e-12 or size < 1e-6:
                    break
                size /= 2
            lam = trial
        return lam
    finally:
        forget(flat)


def distribution(rows: DataFrame, features: list[Column], lam, log_q: Column | None = None) -> DataFrame:
    """rows with p, the normalised weight q exp(-lambda . f). The normaliser is one aggregate, broadcast as one row."""
    x = F.lit(0.0) if log_q is None else log_q
    for f, m in zip(features, lam):
        x = x - float(m) * f
    scored = rows.withColumn("x", x)
    top = scored.agg(F.max("x").alias("top"))
    with_top = scored.crossJoin(F.broadcast(top)).withColumn("e", F.exp(F.col("x") - F.col("top")))
    return with_top.crossJoin(F.broadcast(with_top.agg(F.sum("e").alias("z")))).withColumn("p", F.col("e") / F.col("z")).drop("x", "top", "e", "z")


def entropy(weighted: DataFrame) -> DataFrame:
    """entropy of column p in nats."""
    return weighted.agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))).alias("entropy"))


def draw_with_replacement(weighted: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """draw (0 to n - 1) and the id it fell on, in proportion to p: hashed uniforms looked up in the running sum of p in order of id.

    Rows are sorted over ranges; the driver sees one sum for each range. The draws, one number each,
    are made in every task from the seed, and each row takes those that fall between its ends.
    """
    ordered = keep(weighted.where("p > 0").select(id_col, F.col("p").cast("double").alias("p")).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col).withColumn("part", F.spark_partition_id()))
    sums = sorted((r.part, r.s) for r in ordered.groupBy("part").agg(F.sum("p").alias("s")).collect())
    ends = np.cumsum([s for _, s in sums])
    begins = {part: float(end - s) for (part, s), end in zip(sums, ends)}
    total = float(ends[-1]) if len(ends) else 0.0
    w = Window.partitionBy("part").orderBy(id_col)
    up_to = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = ordered.withColumn("high", up_to).withColumn("low", F.coalesce(F.lag("high").over(w), F.lit(0.0))).select(id_col, "part", "low", "high")

    def run(batches):
        import pyarrow as pa

        u = np.sort(np.random.default_rng(seed).random(n)) * total
        for batch in batches:
            begin = np.array([begins[p] for p in batch.column(1).to_pylist()])
            low, high = begin + batch.column(2).to_numpy(), begin + batch.column(3).to_numpy()
            high = np.where(high >= total * (1 - 1e-12), np.inf, high)
            first, last = np.searchsorted(u, low, side="left"), np.searchsorted(u, high, side="left")
            many = last - first
            number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
            yield pa.RecordBatch.from_arrays([pa.array(number), batch.column(0).take(pa.array(np.repeat(np.arange(len(many)), many)))], names=["draw", id_col])

    return spans.mapInArrow(run, f"draw long, {id_col} {dict(weighted.dtypes)[id_col]}")


def draw(weighted: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n draws without replacement in proportion to p: the n smallest of -ln(u) / p with a hashed uniform, so no running sum over all rows."""
    u = (F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(2**52)) + 0.5) / float(2**52)
    return weighted.where("p > 0").withColumn("race", -F.ln(u) / F.col("p")).orderBy("race", id_col).limit(n).drop("race")


def budgeted_pick(candidates: DataFrame, frame: str, id_col: str, value: str | Column, bucket: str | Column, cost: str | Column, per_bucket: int, budget: float, most: int) -> DataFrame:
    """Greedy pick within each frame by value: a candidate whose bucket is full or that would overrun the budget is skipped, and the next is tried.

    value, bucket and cost are columns' names or the caller's own expressions. Greedy in order, so a frame's
    candidates (bounded) are one worker's.
    """
    import pandas as pd

    given = {"_value": value, "_bucket": bucket, "_cost": cost}
    schema = candidates.schema
    candidates = candidates.withColumns({k: v if isinstance(v, Column) else F.col(v) for k, v in given.items()})
    value, bucket, cost = given

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spent, used, keep = 0.0, {}, []
        for row in pdf.sort_values([value, id_col], ascending=[False, True]).to_dict("records"):
            if len(keep) == most:
                break
            b = row[bucket] if row[bucket] is not None else "<none>"
            if used.get(b, 0) < per_bucket and spent + row[cost] <= budget:
                used[b] = used.get(b, 0) + 1
                spent += row[cost]
                keep.append(row)
        return pd.DataFrame(keep, columns=pdf.columns)[schema.names]

    return candidates.groupBy(frame).applyInPandas(run, schema)


def best_candidate(scored: DataFrame, id_col: str, score: str, turn: int, eps: float = 1e-6) -> DataFrame:
    """The candidate with the top score; of those within a relative eps, the one whose turn it is, in id order.

    Only ties with the top are ordered, by a window over those rows.
    """
    top = scored.agg(F.max(score).alias("top"))
    tied = scored.crossJoin(F.broadcast(top)).where(F.abs(F.col(score) - F.col("top")) <= eps * F.greatest(F.lit(1.0), F.abs("top"))).drop("top")
    w = Window.orderBy(id_col)
    return tied.withColumn("r", F.row_number().over(w) - 1).crossJoin(F.broadcast(tied.agg(F.count("*").alias("n")))).where(F.col("r") == F.lit(turn) % F.col("n")).drop("r", "n")
