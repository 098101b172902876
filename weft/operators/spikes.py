"""Implausible readings, judged against what their own source normally shows.

Per source and in order of time: a robust exponentially weighted control chart of mean
and scale, whose updates use clipped residuals so that suspected values cannot drag
it along; a run-length counter for values that are stuck; and physical limits. Runs
of at most three suspects are then checked exactly against the readings just before
and just after. A run of more suspects is a change of level: the chart moves there.
The chart lags on slopes, so every short run that steps off both its neighbours is
checked too, whether the chart suspects it or not.

Sources larger than a bound are cut along time into overlapping chunks, so that no
task holds an unbounded source; a chunk's margin is far longer than the chart's
memory and than the run lengths that matter. What is usual is still the whole source's:
the chunks' differences are gathered by source first, and every chunk is judged by that.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.grouped import chunked, large_groups, map_groups
from weft.sources.tables import keep

#: Weight of a new reading in the chart, and how many scales away it's suspected.
WEIGHT, SUSPECT = 0.2, 6.0
#: An excursion is off its surroundings by more than so many scatters, and lasts at most so many readings.
EXCURSION, LONGEST = 10.0, 3
#: Equal readings in a row from which on a source is stuck.
STUCK = 15
#: Runs of a value from which on it shows a hardly changing instrument's resolution.
RETURNS = 3
#: Readings of one source in one task.
SOURCE_ROWS = 200_000
#: Quantiles of a cut source's differences are off in rank by one part of so many.
ACCURACY = 100_000


def usual_scatter(x: np.ndarray, run: np.ndarray, valid: np.ndarray) -> tuple[float, float]:
    """Robust scatter of a source from second differences, which level changes and ramps leave alone, and its usual step.

    Readings out of range or repeated three times or more are left out. An instrument can't
    scatter less than its resolution lets it: the smallest step between two readings over root 12.
    Where readings hardly change at all, a step shows the resolution only if it's between values that
    come back (see RETURNS); a value met once or twice is an excursion's, not the instrument's.
    """
    y = x[valid & (run < 3)]
    if len(y) < 8:
        y = x[valid]
    if len(y) < 3:
        return 0.0, 0.0
    d1, d2 = np.abs(np.diff(y)), np.abs(np.diff(y, 2))
    s = 1.4826 * float(np.median(d2)) / 6**0.5
    values = np.unique(x[valid])
    if s == 0:
        z = x[valid]
        starts = z[np.concatenate([[True], z[1:] != z[:-1]])]
        values, times = np.unique(starts, return_counts=True)
        values = values[times >= RETURNS]
    steps = np.diff(values)
    resolution = float(steps[steps > 1e-9 * max(1.0, float(np.abs(y).max()))].min(initial=np.inf))
    return max(s, resolution / 12**0.5 if np.isfinite(resolution) else 0.0), float(np.quantile(d1, 0.9))


def run_lengths(x: np.ndarray) -> np.ndarray:
    """Length of the run of equal readings that each reading is in."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    lengths = np.diff(np.append(starts, len(x)))
    return np.repeat(lengths, lengths)


def chart_suspects(x: np.ndarray, scatter: float) -> list[int]:
    """Positions outside the control chart, run by run; a change of level takes the chart along."""
    values, suspects = x.tolist(), []
    n = len(values)
    if not n or scatter <= 0:
        return suspects
    first = sorted(values[: min(n, 7)])
    mean, scale = first[len(first) // 2], scatter
    low, high, keep, run = 0.5 * scatter, 2.0 * scatter, 1 - WEIGHT, 0
    for i, v in enumerate(values):
        r = v - mean
        limit = SUSPECT * scale
        if -limit <= r <= limit:
            run = 0
            mean += WEIGHT * r
            a = r if r >= 0 else -r
            scale = keep * scale + WEIGHT * 1.2533 * (a if a < 3 * scale else 3 * scale)
            scale = low if scale < low else high if scale > high else scale
        else:
            suspects.append(i)
            run += 1
            if run > LONGEST:
                last = sorted(values[i - LONGEST : i + 1])
                mean, run = (last[1] + last[2]) / 2, 0 if abs(v - (last[1] + last[2]) / 2) <= limit else run
            else:
                mean += WEIGHT * (limit if r > 0 else -limit) * 0.1
    return suspects


def excursions(x: np.ndarray, scatter: float, step: float, suspects: list[int]) -> np.ndarray:
    """Exact check of the chart's suspects: at most three readings in a row, all off the readings just before and after, on one side."""
    n, out = len(x), np.zeros(len(x), dtype=bool)
    limit, calm = EXCURSION * scatter, max(SUSPECT * scatter, 1.5 * step)
    v, marked = x.tolist(), set(suspects)

    def off(i: int, j: int, least: float) -> bool:
        before, after = v[i - 1], v[j + 1]
        low, high = min(before, after), max(before, after)
        return all(a - high > least for a in v[i : j + 1]) or all(low - a > least for a in v[i : j + 1])

    for i in suspects:
        if i < 1 or out[i]:
            continue
        if i - 1 not in marked:  # a run of suspects on its own
            j = i
            while j + 1 < n and j + 1 in marked:
                j += 1
            if j - i < LONGEST and j + 1 < n and off(i, j, limit):
                out[i : j + 1] = True
                continue
        for j in range(i, min(i + LONGEST, n - 1)):  # within a ramp: neighbours must go on as usual
            if off(i, j, max(limit, calm)):
                near = [k for k in (i - 3, i - 2) if k >= 0], [k for k in (j + 1, j + 2) if k + 1 < n]
                if len(near[0]) + len(near[1]) > 2 and all(abs(v[k + 1] - v[k]) <= calm for k in near[0] + near[1]):
                    out[i : j + 1] = True
                break
    return out


def stepped_off(x: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """First and last position of each run of at most three readings that all are off both their neighbours by more than limit, on one side; shorter runs first where they begin alike."""
    found = []
    for length in range(1, min(LONGEST, len(x) - 2) + 1):
        before, after = x[: len(x) - length - 1], x[length + 1 :]
        lowest = highest = x[1 : len(x) - length]
        for k in range(1, length):
            y = x[1 + k : len(x) - length + k]
            lowest, highest = np.minimum(lowest, y), np.maximum(highest, y)
        off = (lowest - np.maximum(before, after) > limit) | (np.minimum(before, after) - highest > limit)
        found += [(i + 1, i + length) for i in np.flatnonzero(off).tolist()]
    return sorted(found)


def add_steps(x: np.ndarray, scatter: float, step: float, out: np.ndarray) -> None:
    """Marks in out the runs of stepped_off that excursions() didn't get to see.

    A reading between two excursions isn't one, so they are looked past; nor is the turn of a steep
    ramp, which is reached from both sides by a step like the one before it.
    """
    n, limit, calm = len(x), EXCURSION * scatter, max(SUSPECT * scatter, 1.5 * step)
    for i, j in stepped_off(x, limit):
        if out[i : j + 1].any():
            continue
        a, b = i - 1, j + 1
        while a >= 0 and out[a]:
            a -= 1
        while b < n and out[b]:
            b += 1
        if a < 0 or b >= n:
            continue
        side = 1.0 if x[i] > x[i - 1] else -1.0
        run = side * x[i : j + 1]
        if run.min() - max(side * x[a], side * x[b]) <= limit:
            continue
        turn = True
        for end, near, far in ((i, a, a - 1), (j, b, b + 1)):
            trend = side * (x[near] - x[far]) if 0 <= far < n and not out[far] else 0.0
            turn &= trend > calm and side * (x[end] - x[near]) <= 2 * trend
        if not turn:
            out[i : j + 1] = True


def judge(x: np.ndarray, low: float, high: float, zeros_rest: bool, usual: tuple[float, float] | None = None) -> np.ndarray:
    """Reason of each reading: 0 none, 1 out of range, 2 stuck, 3 excursion. An unknown limit is NaN; usual is the source's scatter and step if x is part of it."""
    with np.errstate(invalid="ignore"):
        wrong = (x < low) | (x > high)
    run = run_lengths(x)
    stuck = (run >= STUCK) & ~((x == 0) & zeros_rest)
    scatter, step = usual or usual_scatter(x, run, ~wrong)
    reason = np.zeros(len(x), dtype="int8")
    if scatter > 0 or (~wrong).sum() >= 8:  # a source that never scatters has no chart: any short run off both its neighbours stands out
        off = excursions(x, scatter, step, chart_suspects(x, scatter))
        add_steps(x, scatter, step, off)
        reason[off] = 3
    reason[stuck] = 2
    reason[wrong] = 1
    return reason


def _run(part, starts):
    cols = {c: part.column(c).to_numpy() for c in ("row_id", "x", "low", "high")}
    core, rest = part.column("core").to_numpy(), part.column("zeros_rest").to_numpy()
    scatter, step = (part.column(c).to_numpy() for c in ("scatter", "step"))
    take, why = [], []
    for a, b in zip(starts[:-1], starts[1:]):
        ids, x = cols["row_id"][a:b], cols["x"][a:b]
        # Copies of a row stand side by side, as they agree in what is sorted by.
        once = a + np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        reason = judge(cols["x"][once], float(cols["low"][a]), float(cols["high"][a]), bool(rest[a]), None if np.isnan(scatter[a]) else (float(scatter[a]), float(step[a])))
        hit = np.flatnonzero((reason > 0) & core[once])
        take.append(once[hit])
        why.append(reason[hit])
    take = np.concatenate(take)
    names = np.array([None, "range", "stuck", "excursion"], dtype=object)
    picked = part.select(["src", "field"]).take(take)
    return {"src": picked.column("src").combine_chunks(), "row_id": cols["row_id"][take], "field": picked.column("field").combine_chunks(), "reason": names[np.concatenate(why)]}


def _differences(part, starts):
    """What usual_scatter takes quantiles of, for each core reading: d1, d2 without long runs, e1, e2 of all valid readings, NaN for none; the reading, if valid, and whether it begins a run of equal ones."""
    ids, x = part.column("row_id").to_numpy(), part.column("x").to_numpy()
    low, high, core = (part.column(c).to_numpy() for c in ("low", "high", "core"))
    take, found = [], []
    for a, b in zip(starts[:-1], starts[1:]):
        once = a + np.flatnonzero(np.concatenate([[True], ids[a + 1 : b] != ids[a : b - 1]]))
        y = x[once]
        with np.errstate(invalid="ignore"):
            valid = ~((y < low[a]) | (y > high[a]))
        short = valid & (run_lengths(y) < 3)
        out = np.full((7, len(y)), np.nan)
        for row, kept in ((0, np.flatnonzero(short)), (2, np.flatnonzero(valid))):
            out[row, kept[1:]] = np.abs(np.diff(y[kept]))
            if len(kept) > 2:
                out[row + 1, kept[2:]] = np.abs(np.diff(y[kept], 2))
        out[4, short], out[5, valid] = y[short], y[valid]
        out[6, valid] = np.diff(y[valid], prepend=np.nan) != 0
        mine = core[once]
        take.append(once[mine])
        found.append(out[:, mine])
    found = np.concatenate(found, axis=1)
    return {"source": part.column("source").combine_chunks().take(np.concatenate(take))} | {c: found[k] for k, c in enumerate(("d1", "d2", "e1", "e2", "y", "x", "begins"))}


def _gaps(part, starts):
    """Least, greatest and smallest step above the floor of each source's sorted distinct readings, as far as they stand in this partition."""
    x, floor = part.column("x").to_numpy(), part.column("floor").to_numpy()
    least = []
    for a, b in zip(starts[:-1], starts[1:]):
        steps = np.diff(x[a:b])
        least.append(steps[steps > floor[a]].min(initial=np.inf))
    return {"source": part.column("source").combine_chunks().take(starts[:-1]), "floor": floor[starts[:-1]], "first": x[starts[:-1]], "last": x[starts[1:] - 1], "gap": np.array(least)}


def usual_of_sources(grouped: DataFrame) -> DataFrame:
    """source, scatter, step: usual_scatter of sources that are cut into chunks, of all their chunks together.

    Quantiles come from a mergeable sketch (see ACCURACY); the resolution is exact, from the distinct
    readings sorted over all partitions.
    """
    from weft.operators.grouped import bounds_of, groups_of

    d = keep(map_groups(grouped, "key", ["at", "row_id"], _differences, "source string, d1 double, d2 double, e1 double, e2 double, y double, x double, begins double"))
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    half, most = (lambda c: F.percentile_approx(known(c), 0.5, ACCURACY)), (lambda c: F.percentile_approx(known(c), 0.9, ACCURACY))
    few = F.count(known("y")) < 8
    usual = d.groupBy("source").agg(
        F.when(few, half("e2")).otherwise(half("d2")).alias("median"), F.when(few, most("e1")).otherwise(most("d1")).alias("step"),
        (1e-9 * F.greatest(F.lit(1.0), F.when(few, F.max(F.abs(known("x")))).otherwise(F.max(F.abs(known("y")))))).alias("floor"),
    )
    usual = keep(usual)

    def over(batches):
        import pyarrow as pa

        for part in groups_of(batches, "source"):
            columns = _gaps(part, bounds_of(part.column("source")))
            yield pa.RecordBatch.from_arrays([pa.array(columns["source"].to_pylist(), pa.string()), *(pa.array(columns[c], pa.float64()) for c in ("floor", "first", "last", "gap"))], ["source", "floor", "first", "last", "gap"])

    times = d.where(~F.isnan("x")).groupBy("source", "x").agg(F.sum("begins").alias("times"))
    values = times.join(usual.select("source", "floor", "median"), "source").where((F.col("median") > 0) | (F.col("times") >= RETURNS)).select("source", "x", "floor")
    spans = values.repartitionByRange("source", "x").sortWithinPartitions("source", "x").mapInArrow(over, "source string, floor double, first double, last double, gap double")
    # Spans of one source don't overlap: a step also lies between one's end and the next one's start.
    across = F.col("first") - F.lag("last").over(Window.partitionBy("source").orderBy("first"))
    gaps = spans.withColumn("across", across).groupBy("source").agg(F.least(F.min("gap"), F.coalesce(F.min(F.when(F.col("across") > F.col("floor"), F.col("across"))), F.lit(float("inf")))).alias("gap"))
    resolution = F.when(F.col("gap") < float("inf"), F.col("gap") / 12**0.5).otherwise(0.0)
    scatter = F.greatest(1.4826 * F.coalesce("median", F.lit(0.0)) / 6**0.5, F.coalesce(resolution, F.lit(0.0)))
    return usual.join(gaps, "source", "left").select("source", scatter.alias("scatter"), F.coalesce("step", F.lit(0.0)).alias("step"))


def flag_spikes(readings: DataFrame, source_rows: int = SOURCE_ROWS) -> DataFrame:
    """src, row_id, field, reason ('range', 'stuck', 'excursion') of each implausible reading.

    readings: src, field (which table and column), source (whose normal behaviour counts),
    row_id, at (sortable order), x, low, high (physical limits, null if unknown), zeros_rest
    (exact zeros may stand still). Null and NaN readings and rows without an id, a source or
    a place in order are not judged; a repeated row_id counts once, the first in order; ties in
    order go by row_id; an empty table gives no rows; other columns are not read.
    """
    known = readings.where("x is not null and not isnan(x) and row_id is not null and source is not null and at is not null and not isnan(at)")
    keyed = known.select(
        F.concat_ws("\x1f", "src", "field", "source").alias("key"), "src", "field", F.col("row_id").cast("long").alias("row_id"), F.col("at").cast("double").alias("at"), F.col("x").cast("double").alias("x"),
        F.coalesce(F.col("low").cast("double"), F.lit(float("nan"))).alias("low"), F.coalesce(F.col("high").cast("double"), F.lit(float("nan"))).alias("high"), "zeros_rest",
    )
    many = keep(large_groups(keyed, "key", source_rows))
    hot = not many.isEmpty()
    if hot:
        # Copies of a row must not fall to two chunks: in large sources they are dropped first, elsewhere where the source is judged.
        rest = [c for c in keyed.columns if c not in ("key", "row_id")]
        large = keyed.join(many.select("key"), "key").groupBy("key", "row_id").agg(F.min(F.struct("at", *(c for c in rest if c != "at"))).alias("r")).select("key", "row_id", *(f"r.{c}" for c in rest))
        keyed = keyed.join(many.select("key"), "key", "left_anti").unionByName(large)
    cut = chunked(keyed, "key", ["at", "row_id"], source_rows, many=many) if hot else keyed.withColumn("chunk", F.lit(0)).withColumn("core", F.lit(True))
    grouped = cut.withColumn("source", F.col("key")).withColumn("key", F.concat_ws("\x1f", "key", F.col("chunk").cast("string"))).drop("chunk")
    if hot:
        usual = usual_of_sources(grouped.join(many.select(F.col("key").alias("source")), "source", "left_semi"))
        grouped = grouped.join(keep(usual), "source", "left")
    else:
        grouped = grouped.withColumn("scatter", F.lit(None).cast("double")).withColumn("step", F.lit(None).cast("double"))
    grouped = grouped.drop("source").fillna(float("nan"), ["scatter", "step"])
    return map_groups(grouped, "key", ["at", "row_id"], _run, "src string, row_id long, field string, reason string")
