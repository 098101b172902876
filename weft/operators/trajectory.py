"""Trajectories of distributions and kernels in time, their convergence, and time integrals."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.grouped import chunked, large_groups, map_groups, numbered
from weft.sources.tables import keep


def shares_in_time(rows: DataFrame, key: str, t: Column, category: str, categories: list[str]) -> DataFrame:
    """key, t, shares: one array of category shares for each key and time; a diagonal kernel for each snapshot."""
    counts = [F.count(F.when(F.col(category) == c, 1)) for c in categories]
    total = reduce(lambda a, b: a + b, counts)
    return rows.where(f"{key} is not null").groupBy(key, t.alias("t")).agg(total.alias("total"), F.array(*counts).alias("n")).where("t is not null and total > 0").select(key, "t", F.transform("n", lambda x: x / F.col("total")).alias("shares"))


def array_distance(a: Column, b: Column) -> Column:
    """Hilbert-Schmidt distance of two diagonal kernels: root of the summed squares over root n; null unless the sizes agree."""
    d2 = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(d2) / F.sqrt(F.size(a).cast("double")))


def segments(snapshots: DataFrame, key: str, t: str = "t", value: str = "shares") -> DataFrame:
    """key, step, t0, t, distance, length, speed of each consecutive pair of snapshots; a zero time step counts as 1e-12."""
    w = Window.partitionBy(key).orderBy(t)
    pairs = snapshots.select(key, F.col(t).cast("double").alias("t"), F.col(value).alias("v")).withColumn("t0", F.lag("t").over(w)).withColumn("v0", F.lag("v").over(w)).withColumn("step", F.row_number().over(w) - 1).where("step > 0")
    pairs = pairs.withColumn("distance", F.coalesce(array_distance(F.col("v0"), F.col("v")), F.lit(0.0)))
    dt = F.col("t") - F.col("t0")
    return pairs.select(key, "step", "t0", "t", "distance", F.sum("distance").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("length"), (F.col("distance") / F.when(dt == 0, 1e-12).otherwise(dt)).alias("speed"))


def summary(segs: DataFrame, key: str, tol: float, window: int) -> DataFrame:
    """key, n_segments, path_length, convergent, convergence_time, decay_rate.

    Convergent: the last `window` distances are below tol. Convergence time: start of the first
    `window` distances below tol. Decay rate: minus the slope of the log distance over mid-times,
    0 with fewer than three segments or two positive distances.
    """
    ahead = Window.partitionBy(key).orderBy("step").rowsBetween(0, window - 1)
    back = Window.partitionBy(key).orderBy("step").rowsBetween(-(window - 1), 0)
    last = Window.partitionBy(key).orderBy(F.desc("step"))
    below = F.col("distance") < tol
    marked = segs.withColumn("run", (F.count(F.when(below, 1)).over(ahead) == window)).withColumn("tail", (F.count(F.when(below, 1)).over(back) == window)).withColumn("r", F.row_number().over(last))
    y, x = F.when(F.col("distance") > 0, F.ln("distance")), F.when(F.col("distance") > 0, (F.col("t0") + F.col("t")) / 2)
    return marked.groupBy(key).agg(
        F.count("*").alias("n_segments"),
        F.sum("distance").alias("path_length"),
        F.max(F.when(F.col("r") == 1, F.col("tail"))).alias("convergent"),
        F.min(F.when(F.col("run"), F.col("t0"))).alias("convergence_time"),
        F.when((F.count("*") >= 3) & (F.count(y) >= 2), F.coalesce(-F.regr_slope(y, x), F.lit(0.0))).otherwise(0.0).alias("decay_rate"),
    )


def fixed_point_state(segs: DataFrame, key: str, tol: float, window: int) -> DataFrame:
    """key, stability, phase, steps of the last state: 'insufficient_data', 'stable_fp', 'transient' or 'oscillating'.

    stability is 1 - mean of the last `window` distances / tol, never negative; steps is the
    number of snapshots after which the first `window` distances below tol were complete.
    """
    order = Window.partitionBy(key).orderBy("step")
    back, last = order.rowsBetween(-(window - 1), 0), Window.partitionBy(key).orderBy(F.desc("step"))
    rise = F.when(F.col("step") > 1, F.col("distance") - F.lag("distance").over(order))
    inner = order.rowsBetween(-(window - 2), 0)
    marked = (
        segs.withColumn("rise", rise)
        .withColumn("n", F.count("*").over(back))
        .withColumn("low", F.count(F.when(F.col("distance") < tol, 1)).over(back))
        .withColumn("mean", F.avg("distance").over(back))
        .withColumn("top_rise", F.max("rise").over(inner))
        .withColumn("r", F.row_number().over(last))
    )
    full = F.col("n") >= window
    steps = segs.withColumn("low", F.count(F.when(F.col("distance") < tol, 1)).over(back)).groupBy(key).agg(F.min(F.when(F.col("low") == window, F.col("step"))).alias("steps"))
    phase = F.when(~full, "insufficient_data").when(F.col("low") == window, "stable_fp").when(F.coalesce(F.col("top_rise"), F.lit(0.0)) <= 0, "transient").otherwise("oscillating")
    state = marked.where("r = 1").select(key, F.when(full, F.greatest(F.lit(0.0), 1 - F.col("mean") / tol)).otherwise(0.0).alias("stability"), phase.alias("phase"))
    return state.join(steps, key)


#: Rows of one key in one task; longer series are cut along time.
SERIES_ROWS = 1_000_000


def interpolate(samples: DataFrame, grid: DataFrame, key: str, t: str, value: str, rows: int = SERIES_ROWS) -> DataFrame:
    """key, t, value of each grid time: linear between the samples around it, the end's value beyond an end.

    Samples and grid are one sorted sequence for each key, so the as-of lookup is a window and
    not a range join. Repeated sample times count by their mean. Keys of more than `rows` rows are cut
    into pieces; each piece knows the last sample before it and the first after it.
    """
    once = samples.where(f"{t} is not null and {value} is not null").groupBy(key, F.col(t).cast("double").alias("t")).agg(F.avg(value).alias("v"))
    both = once.select(key, "t", "v", F.lit(0).alias("asked")).unionByName(grid.select(key, F.col(t).cast("double").alias("t"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("asked")))
    many = keep(large_groups(both, key, rows))
    none = F.lit(None).cast("struct<t:double,v:double>")
    pieces = both.withColumn("piece", F.lit(0).cast("long")).withColumns({"before": none, "after": none})
    at = F.when(F.col("v").isNotNull(), F.struct(F.col("t").alias("t"), F.col("v").alias("v")))
    if not many.isEmpty():
        long = numbered(both.join(many.select(key), key), key, ["t", "asked"]).withColumn("piece", F.floor(F.col("rn") / rows)).drop("rn")
        ends = long.groupBy(key, "piece").agg(F.max(at).alias("last"), F.min(at).alias("first"))
        over = Window.partitionBy(key).orderBy("piece")
        known = ends.select(key, "piece", F.last("last", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
        pieces = pieces.join(many.select(key), key, "left_anti").unionByName(long.join(known, [key, "piece"]))
    w = Window.partitionBy(key, "piece").orderBy("t", "asked")
    past, next_ = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    near = pieces.withColumn("a", F.coalesce(F.last(at, True).over(past), F.col("before"))).withColumn("b", F.coalesce(F.first(at, True).over(next_), F.col("after"))).where("asked = 1")
    share = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    blend = F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (F.col("b.t") == F.col("a.t")), F.col("a.v")).otherwise((1 - share) * F.col("a.v") + share * F.col("b.v"))
    return near.select(key, "t", blend.alias("value"))


def trapezoid(samples: DataFrame, key: str, t: Column, value: str) -> DataFrame:
    """key, n, energy: the integral of value over time in seconds by the trapezoid rule."""
    w = Window.partitionBy(key).orderBy("t", "v")
    rows = samples.select(key, t.cast("double").alias("t"), F.col(value).alias("v")).where("t is not null and v is not null and not isnan(v)")
    area = (F.col("t") - F.lag("t").over(w)) * (F.col("v") + F.lag("v").over(w)) / 2
    return rows.withColumn("area", area).groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("energy"))


def first_crossing(rows: DataFrame, key: str, t: str, value: str, share: float = 0.1, early: float = 0.2) -> DataFrame:
    """key, threshold, first_t: the `share` quantile of the first `early` part of each series, and when it's first gone below."""
    w = Window.partitionBy(key).orderBy(t, value)
    ranked = rows.where(f"{t} is not null and {value} is not null").withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    limit = ranked.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * early))).groupBy(key).agg(F.percentile(value, F.lit(share)).alias("threshold"))
    return ranked.join(limit, key).groupBy(key).agg(F.first("threshold").alias("threshold"), F.min(F.when(F.col(value) < F.col("threshold"), F.col(t))).alias("first_t"))


def ema(rows: DataFrame, key: str, order: str, value: str, alpha: float, start: float = 0.0, bound: int = SERIES_ROWS) -> DataFrame:
    """key, order, value, smooth: exponential smoothing s = (1 - alpha) s + alpha x, from `start`.

    The recurrence has no window form that is stable in floating point, so each key's series is
    folded in order; keys are cut from sorted partitions. A series of more than `bound` rows is cut into
    chunks that begin so far ahead (a tenth of the bound, at least 45 / alpha rows) that what lies before has no weight left.
    """
    kind = dict(rows.dtypes)
    flat = rows.where(f"{key} is not null and {order} is not null and {value} is not null").select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("x"))
    cut = chunked(flat, "k", ["o", "x"], max(bound, math.ceil(450 / alpha))).withColumn("group", F.concat_ws("\x1f", "k", F.col("chunk").cast("string")))

    def run(part, starts):
        x, core = part.column("x").to_numpy(), part.column("core").to_numpy()
        out = np.empty(len(x))
        for a, b in zip(starts[:-1], starts[1:]):
            s = start
            for i in range(a, b):
                s = (1 - alpha) * s + alpha * x[i]
                out[i] = s
        mine = np.flatnonzero(core)
        return {"k": part.column("k").combine_chunks().take(mine), "o": part.column("o").combine_chunks().take(mine), "x": x[mine], "smooth": out[mine]}

    return map_groups(cut, "group", ["o", "x"], run, f"k string, o {kind[order]}, x double, smooth double").select(F.col("k").cast(kind[key]).alias(key), F.col("o").alias(order), F.col("x").alias(value), "smooth")


def largest_drop(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, at, drop: where a series falls most from one step to the next, the first of equals; series that never fall are left out."""
    w = Window.partitionBy(key).orderBy(order)
    falls = rows.where(f"{value} is not null").withColumn("drop", F.lag(value).over(w) - F.col(value)).where("drop > 0")
    best = falls.groupBy(key).agg(F.max(F.struct(F.col("drop"), (-F.col(order).cast("double")).alias("first"), F.col(order).alias("at"))).alias("m"))
    return best.select(key, "m.at", "m.drop")


def stage_of(samples: DataFrame, stages: DataFrame, key: str, t: str, epoch: float) -> DataFrame:
    """samples with the stage of the epoch that holds their time in seconds, null where none is given. stages: key, epoch number, stage."""
    numbered = samples.withColumn("epoch", F.floor(F.col(t) / epoch).cast("long"))
    return numbered.join(stages.select(key, F.col("epoch").cast("long").alias("epoch"), "stage"), [key, "epoch"], "left")


def recent(rows: DataFrame, key: str, order: str, value: str, n: int = 60) -> DataFrame:
    """rows with count, mean and largest of the last n values, the present one included."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
    return rows.withColumns({"recent_n": F.count(value).over(w), "recent_mean": F.avg(value).over(w), "recent_max": F.max(value).over(w)})


def running_share(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with the running sum of a value and its share of the key's total (0 without a total)."""
    w = Window.partitionBy(key)
    run, total = F.sum(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.sum(value).over(w)
    return rows.withColumn("running", run).withColumn("share", F.when(total != 0, F.col("running") / total).otherwise(0.0))


def sample_windows(rows: DataFrame, key: str, order: str, width: int, stride: int) -> DataFrame:
    """rows with win (0, 1, ...), each row once for every window of `width` samples, a `stride` apart, that holds it; a key's last, incomplete windows are left out.

    Samples are numbered by key and time; each is handed to its windows, so overlapping windows need no self-join.
    """
    w = Window.partitionBy(key).orderBy(order)
    at = rows.withColumn("_n", F.row_number().over(w) - 1).withColumn("_all", F.count("*").over(Window.partitionBy(key)))
    first = F.greatest(F.lit(0), F.ceil((F.col("_n") - (width - 1)) / stride)).cast("int")
    last = F.least(F.floor(F.col("_n") / stride), F.floor((F.col("_all") - width) / stride)).cast("int")
    held = at.where(F.col("_all") >= width).withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    return held.withColumn("win", F.explode(F.sequence("_first", "_last"))).drop("_n", "_all", "_first", "_last")
