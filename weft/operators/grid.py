"""Irregular readings onto a regular grid, gaps filled by low-rank factorisation.

Readings are averaged per source and period. Sources and periods form matrices: the
rows are sources with the same interval, the columns periods of the clock, so that
sources recorded at the same time share their columns. A matrix is cut along the
clock into chunks, and where a chunk has many sources into blocks of sources of
like level. A cell is modelled as its row's local level (the middle of the observed
cells around it) plus a low-rank term over all the block's sources, fitted by
alternating least squares with a ridge to what the local level leaves of the observed
cells. Observed cells stay exactly as they are; a missing cell gets the fit if its row
has enough observed cells around it, or its row and its column have enough in the
block, else it stays marked as unsupported.

A chunk also sees the cells within reach of its ends, so local levels, and with them
which rows support a cell, don't depend on where the clock is cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.grouped import map_groups
from weft.sources.tables import keep

#: Periods and sources of one block, the rank, the ridge in units of the block's variance, and sweeps.
COLUMNS, ROWS, RANK, RIDGE, SWEEPS = 256, 256, 2, 0.5, 8
#: Periods on either side whose observed cells make a cell's local level, and how many of them at most.
REACH, NEAREST = 16, 6
#: Observed cells within reach, or in the block's row and column, that a missing cell needs to be filled.
ROW_SUPPORT, COLUMN_SUPPORT = 3, 2
#: Cuts by level of a chunk with many sources.
LEVELS = 64


def cells_of(readings: DataFrame) -> DataFrame:
    """source, interval, k, value: the mean of each source's distinct readings in each period that has any.

    readings: source, interval (seconds), reading_id, micros (since the epoch), x; period k
    covers [k*interval, (k+1)*interval) seconds. Copies of a reading_id count once; readings
    without an id can't be told to be copies and count each.
    """
    width = F.col("interval").cast("long") * 1_000_000
    k = ((F.col("micros") - F.pmod(F.col("micros"), width)) / width).cast("long")
    placed = readings.where("source is not null and interval > 0 and micros is not null and x is not null and not isnan(x)").select("source", F.col("interval").cast("int").alias("interval"), k.alias("k"), "reading_id", "x")
    # Both aggregations are satisfied by the one exchange on (source, interval, k). Without an id, readings are summed as they are.
    known = F.col("reading_id").isNotNull()
    once = placed.repartition("source", "interval", "k").groupBy("source", "interval", "k", "reading_id").agg(F.when(known, F.min("x")).otherwise(F.sum("x")).alias("x"), F.when(known, F.lit(1)).otherwise(F.count("*")).alias("n"))
    return once.groupBy("source", "interval", "k").agg((F.sum("x") / F.sum("n")).alias("value"))


def factorise(values: np.ndarray, seen: np.ndarray, rank: int = RANK, ridge: float = RIDGE, sweeps: int = SWEEPS) -> np.ndarray:
    """Row level plus low-rank fit of a matrix's seen cells by alternating least squares; deterministic start."""
    n, m = values.shape
    counts = seen.sum(1)
    level = np.where(seen, values, 0).sum(1) / np.maximum(counts, 1)
    rest = np.where(seen, values - level[:, None], 0.0)
    spread = float((rest**2).sum() / max(1, seen.sum()))
    rank = min(rank, n, m)
    if spread == 0 or rank == 0:
        return np.repeat(level[:, None], m, 1)
    eye = np.eye(rank) * ridge
    weights = seen.astype(float)
    rest /= spread**0.5
    v = np.cos(np.outer(np.arange(m) + 0.5, np.arange(rank)) * np.pi / m)
    for _ in range(sweeps):
        gram = np.einsum("nm,ma,mb->nab", weights, v, v, optimize=True) + eye
        u = np.linalg.solve(gram, (rest @ v)[:, :, None])[:, :, 0]
        gram = np.einsum("nm,na,nb->mab", weights, u, u, optimize=True) + eye
        v = np.linalg.solve(gram, (rest.T @ u)[:, :, None])[:, :, 0]
    return level[:, None] + (u @ v.T) * spread**0.5


def local_levels(values: np.ndarray, seen: np.ndarray, reach: int = REACH, nearest: int = NEAREST, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Middle of up to `nearest` observed cells on each side within reach, the cell itself left out, and how many they are; NaN without any. Only wanted cells, if given, are worked out."""
    n, m = values.shape
    level, count = np.full((n, m), np.nan), np.zeros((n, m), int)
    steps = np.arange(nearest)
    for i in range(n):
        known = np.flatnonzero(seen[i])
        at = np.arange(m) if wanted is None else np.flatnonzero(wanted[i])
        if not len(known) or not len(at):
            continue
        before, after = np.searchsorted(known, at, side="left"), np.searchsorted(known, at, side="right")
        picks = np.concatenate([before[:, None] - 1 - steps, after[:, None] + steps], axis=1)
        inside = (picks >= 0) & (picks < len(known))
        where = known[np.clip(picks, 0, len(known) - 1)]
        inside &= np.abs(where - at[:, None]) <= reach
        near = np.sort(np.where(inside, values[i, where], np.nan), axis=1)  # unknown ones come last
        have = inside.sum(1)
        row = np.arange(len(at))
        middle = (near[row, np.maximum(have - 1, 0) // 2] + near[row, np.minimum(have // 2, 2 * nearest - 1)]) / 2
        count[i, at], level[i, at] = have, np.where(have > 0, middle, np.nan)
    return level, count


def common_course(rest: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Low-rank fit of what levels leave of the seen cells, as far as it can be trusted.

    Two halves of the cells, as on a chessboard, are each foretold from the other; the fit of all is
    scaled by how much of the cells such forecasts explain (0 to 1). Sources that merely run at the same time
    so get nothing from each other. A spike must not turn the factors: a cell counts up to three times its row's usual.
    """
    usual = np.array([1.4826 * np.median(np.abs(r[s])) if s.any() else 0.0 for r, s in zip(rest, seen)])[:, None]
    rest = np.where(seen, np.clip(rest, -3 * usual, 3 * usual), 0.0)
    white = np.add.outer(np.arange(rest.shape[0]), np.arange(rest.shape[1])) % 2 == 0
    foretold = np.zeros(rest.shape)
    for half in (white, ~white):
        foretold = np.where(seen & ~half, factorise(rest, seen & half), foretold)
    told = float((foretold * rest)[seen].sum())
    if told <= 0:
        return np.zeros(rest.shape)
    return factorise(rest, seen) * min(1.0, told / float((foretold[seen] ** 2).sum()))


def complete(values: np.ndarray, seen: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The fit of every cell of a block, or at least of the wanted ones, and which cells have enough support for it.

    Near observed cells of its row a cell is their local level plus the low-rank term of what
    that leaves; far from any it's the row's level plus the low-rank term of the row's whole course.
    Only columns that several rows share have such terms; see common_course().
    """
    shared = seen.sum(0) >= COLUMN_SUPPORT
    local, count = local_levels(values, seen, wanted=None if wanted is None else wanted | (seen & shared[None, :]))
    near = count >= ROW_SUPPORT
    far = ~near & (seen.sum(1) >= ROW_SUPPORT)[:, None] & shared[None, :]
    fit = np.where(np.isnan(local), 0.0, local)
    if shared.any():
        told = seen & near & shared[None, :]
        fit = fit + np.where(shared[None, :], common_course(values - fit, told), 0.0)
        if (far & (~seen if wanted is None else wanted)).any():
            level = np.array([np.median(v[s]) if s.any() else 0.0 for v, s in zip(values, seen)])[:, None]
            fit = np.where(near, fit, level + common_course(values - level, seen))
    return fit, near | far


def _fill(part, starts):
    source, k, first, last, value, real = (part.column(c) for c in ("source", "k", "first", "last", "value", "real"))
    interval, chunk = part.column("interval").to_numpy(), part.column("chunk").to_numpy()
    code = source.combine_chunks().dictionary_encode()
    names, codes = code.dictionary, code.indices.to_numpy()
    k, first, last, value, real = k.to_numpy(), first.to_numpy(), last.to_numpy(), value.to_numpy(), real.to_numpy()
    who, when, fill, state = [], [], [], []
    for a, b in zip(starts[:-1], starts[1:]):
        rows, where = np.unique(codes[a:b], return_inverse=True)
        start, end = np.ones(len(rows), "int64"), np.zeros(len(rows), "int64")  # a source known only from beyond the chunk's end has nothing to fill
        mark = np.flatnonzero(~real[a:b])
        start[where[mark]], end[where[mark]] = first[a + mark], last[a + mark]
        base = chunk[a] * COLUMNS - REACH
        m = COLUMNS + 2 * REACH
        values, seen = np.zeros((len(rows), m)), np.zeros((len(rows), m), dtype=bool)
        cell = np.flatnonzero(real[a:b])
        values[where[cell], k[a + cell] - base] = value[a + cell]
        seen[where[cell], k[a + cell] - base] = True
        at = base + np.arange(m)
        mine = (at[None, :] >= np.maximum(start, base + REACH)[:, None]) & (at[None, :] <= np.minimum(end, base + REACH + COLUMNS - 1)[:, None])
        i, j = np.nonzero(mine & ~seen)
        if not len(i):
            continue
        fit, enough = complete(values, seen, mine & ~seen)
        supported = enough[i, j]
        who.append(rows[i])
        when.append(at[j] * int(interval[a]))
        fill.append(np.where(supported, fit[i, j], np.nan))
        state.append(np.where(supported, "filled", "unsupported"))
    if not who:
        return {"source": [], "period_start": [], "value": [], "state": []}
    return {"source": names.take(np.concatenate(who)), "period_start": np.concatenate(when), "value": np.concatenate(fill), "state": np.concatenate(state).astype(object)}


def missing_cells(cells: DataFrame, rows: int = ROWS) -> DataFrame:
    """source, period_start, value, state: each empty period between a source's first and last, 'filled' or 'unsupported' (value null).

    A block has about `rows` sources: a chunk of the clock with more is cut at quantiles of the
    sources' levels, and beyond LEVELS times as many also by a hash of the source.
    """
    spans = cells.groupBy("source", "interval").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.avg("value").alias("level"))
    chunk_of = lambda k: F.floor(k / COLUMNS).cast("long")
    # A marker for each source and chunk, so that wholly empty chunks are there too.
    marks = spans.select("source", "interval", "first", "last", "level", F.explode(F.sequence(chunk_of(F.col("first")), chunk_of(F.col("last")))).alias("chunk"))
    crowds = marks.groupBy("interval", "chunk").agg(F.count("*").alias("n"), F.percentile_approx("level", [i / LEVELS for i in range(1, LEVELS)], 1_000).alias("q")).where(F.col("n") > rows)
    step = F.greatest(F.lit(1), F.floor(F.lit(LEVELS * rows) / F.col("n"))).cast("int")
    crowds = keep(crowds.select("interval", "chunk", F.filter("q", lambda c, i: (i + 1) % step == 0).alias("cuts"), F.ceil(F.col("n") / (LEVELS * rows)).alias("parts")))
    # A cell within reach of a chunk's end is seen by the chunk beyond it too.
    seen = cells.select("source", "interval", "k", "value", F.explode(F.sequence(chunk_of(F.col("k") - REACH), chunk_of(F.col("k") + REACH))).alias("chunk"))
    nothing = F.lit(None).cast("long")
    both = marks.select("source", "interval", "chunk", "first", "last", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("value"), F.lit(False).alias("real")).unionByName(
        seen.select("source", "interval", "chunk", nothing.alias("first"), nothing.alias("last"), "k", "value", F.lit(True).alias("real"))
    )
    here = F.concat_ws("/", F.col("interval").cast("string"), F.col("chunk").cast("string"))
    if crowds.isEmpty():
        placed = both.withColumn("block", here)
    else:
        rung, part = F.size(F.filter("cuts", lambda c: c <= F.col("level"))), F.pmod(F.xxhash64("source"), F.col("parts"))
        where = both.join(crowds, ["interval", "chunk"], "left").join(spans.select("source", "interval", "level"), ["source", "interval"])
        placed = where.withColumn("block", F.when(F.col("cuts").isNull(), here).otherwise(F.concat_ws("/", here, rung.cast("string"), part.cast("string")))).drop("cuts", "parts", "level")
    return map_groups(placed, "block", ["source"], _fill, "source string, period_start long, value double, state string")


def regular_grid(readings: DataFrame, rows: int = ROWS) -> DataFrame:
    """source, period_start (epoch seconds), value, state of every period from each source's first reading to its last.

    Defined cases: a source with one reading has one period; a period is 'observed' with the
    exact mean of its readings, 'filled' with the fit, or 'unsupported' with a null
    value; readings that are null, NaN, without a stamp or a source, or with an interval that
    is null or not positive, are left out; readings without an id count each; stamps before
    1970 have negative periods; an empty table gives none; other columns aren't read.
    """
    cells = keep(cells_of(readings))
    seen = cells.select("source", (F.col("k") * F.col("interval")).alias("period_start"), "value", F.lit("observed").alias("state"))
    return seen.unionByName(missing_cells(cells, rows))
