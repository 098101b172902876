"""Rasters as cells raster_id, r, c, z: gradients, flow directions, accumulation, stream order."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.tables import forget, keep

# The eight neighbours in the order of their codes 0 to 7.
OFFSETS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def _derivative(z: str, along: str, across: str, step: float) -> Column:
    """Central difference inside, one-sided at an end, from cells whose neighbours along a line are present."""
    w = Window.partitionBy("raster_id", across).orderBy(along)
    before = F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag(z).over(w))
    after = F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead(z).over(w))
    return F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * step)).when(after.isNotNull(), (after - F.col(z)) / step).when(before.isNotNull(), (F.col(z) - before) / step)


def gradients(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """cells with zx, zy."""
    return cells.withColumn("zx", _derivative("z", "c", "r", dx)).withColumn("zy", _derivative("z", "r", "c", dy))


def slope(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """raster_id, r, c, slope in height a length; borders have one-sided differences."""
    return gradients(cells, dx, dy).select("raster_id", "r", "c", F.sqrt(F.col("zx") * F.col("zx") + F.col("zy") * F.col("zy")).alias("slope"))


def curvature(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """raster_id, r, c, planform (sum of second derivatives) and profile (along the gradient)."""
    g = keep(gradients(cells, dx, dy))
    second = g.withColumn("zxx", _derivative("zx", "c", "r", dx)).withColumn("zyy", _derivative("zy", "r", "c", dy)).withColumn("zxy", _derivative("zx", "r", "c", dy))
    square = F.col("zx") * F.col("zx") + F.col("zy") * F.col("zy") + 1e-12
    bend = F.col("zx") * F.col("zx") * F.col("zxx") + 2 * F.col("zx") * F.col("zy") * F.col("zxy") + F.col("zy") * F.col("zy") * F.col("zyy")
    return second.select("raster_id", "r", "c", (F.col("zxx") + F.col("zyy")).alias("planform"), (bend / square).alias("profile"))


def _by_cell(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join of tables that may both have a row for each cell: by sorting, never broadcast.

    Cells compress so well, and generated ones are estimated so low, that Spark would take a table of
    millions of them for a small one and build it on the driver.
    """
    return left.join(right.hint("merge"), on, how)


def flow_direction(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """raster_id, r, c, z, direction: code of the steepest fall, the first of equals; -1 for a pit or a flat.

    A fall is over dx for a neighbour in the row, dy in the column, and dx times root two on the diagonal.
    Each cell is handed to itself and to its eight neighbours, one row for each direction from which a
    neighbour can look at it, and all that a cell sees meets in one aggregation, without a join.
    """
    known = cells.where("z is not null and not isnan(z)")
    places = [(None, 0, 0), *((d, -dr, -dc) for d, (dr, dc) in enumerate(OFFSETS))]
    handed = F.explode(F.array(*(F.struct(F.lit(d).cast("int").alias("d"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for d, dr, dc in places))).alias("o")
    given = known.select("raster_id", "r", "c", "z", handed).select("raster_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), F.col("o.d").alias("d"), "z")
    seen = given.groupBy("raster_id", "r", "c").agg(F.min(F.when(F.col("d").isNull(), F.col("z"))).alias("z"), *(F.min(F.when(F.col("d") == d, F.col("z"))).alias(f"z{d}") for d in range(8))).where("z is not null")
    falls = seen.select("raster_id", "r", "c", "z", *(((F.col("z") - F.col(f"z{d}")) / F.lit((dx * (2**0.5 if dr else 1.0)) if dc else dy)).alias(f"fall{d}") for d, (dr, dc) in enumerate(OFFSETS)))
    steepest = F.greatest(*(f"fall{d}" for d in range(8)))
    first = F.coalesce(*(F.when(F.col(f"fall{d}") == F.col("fall"), F.lit(d)) for d in range(8)))
    return falls.withColumn("fall", steepest).select("raster_id", "r", "c", "z", F.coalesce(F.when(F.col("fall") > 0, first), F.lit(-1)).alias("direction"))


def downstream(directed: DataFrame) -> DataFrame:
    """raster_id, r, c, r2, c2: the cell that each cell with a direction flows to."""
    dr, dc = F.lit(None).cast("int"), F.lit(None).cast("int")
    for d, (a, b) in enumerate(OFFSETS):
        dr, dc = F.when(F.col("direction") == d, a).otherwise(dr), F.when(F.col("direction") == d, b).otherwise(dc)
    return directed.where("direction >= 0").select("raster_id", "r", "c", (F.col("r") + dr).alias("r2"), (F.col("c") + dc).alias("c2"))


def flow_accumulation(directed: DataFrame) -> DataFrame:
    """raster_id, r, c, accumulation: cells upstream, itself included.

    By doubling: with a(v) the cells fewer than n steps upstream of v and each cell's n-th cell
    downstream known, those fewer than 2n steps upstream are a(v) and the a(u) of all u whose n-th
    cell is v. So rounds are the logarithm of the longest path, and each is an aggregation.
    """
    cell = ["raster_id", "r", "c"]
    state = keep(_by_cell(directed.select(*cell, F.lit(1).cast("long").alias("a")), downstream(directed), cell, "left"))
    while True:
        moving = state.where("r2 is not null")
        if moving.isEmpty():
            return state.select(*cell, F.col("a").alias("accumulation"))
        gained = moving.groupBy("raster_id", F.col("r2").alias("r"), F.col("c2").alias("c")).agg(F.sum("a").alias("more"))
        further = state.select("raster_id", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("r2").alias("r4"), F.col("c2").alias("c4"))
        now = keep(_by_cell(_by_cell(state, gained, cell, "left"), further, ["raster_id", "r2", "c2"], "left").select(*cell, (F.col("a") + F.coalesce("more", F.lit(0).cast("long"))).alias("a"), F.col("r4").alias("r2"), F.col("c4").alias("c2")))
        forget(state)
        state = now


def channels(accumulated: DataFrame, least: int) -> DataFrame:
    return accumulated.where(F.col("accumulation") >= least)


def drainage_edges(directed: DataFrame, channel: DataFrame) -> DataFrame:
    """raster_id, r, c, r2, c2 of channel cells that flow to channel cells."""
    cells = channel.select("raster_id", "r", "c")
    starting = _by_cell(downstream(directed), cells, ["raster_id", "r", "c"], "left_semi")
    return _by_cell(starting, cells.select("raster_id", F.col("r").alias("r2"), F.col("c").alias("c2")), ["raster_id", "r2", "c2"], "left_semi").select("raster_id", "r", "c", "r2", "c2")


def _downstream_of(seeds: DataFrame, cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of the cells that are seeds or lie downstream of one, by doubling as in flow_accumulation()."""
    cell = ["raster_id", "r", "c"]
    marked = _by_cell(cells.select(*cell), seeds.select(*cell, F.lit(True).alias("hit")), cell, "left")
    state = keep(_by_cell(marked, edges, cell, "left").select(*cell, F.coalesce("hit", F.lit(False)).alias("hit"), "r2", "c2"))
    while not state.where("r2 is not null").isEmpty():
        told = state.where("hit and r2 is not null").select("raster_id", F.col("r2").alias("r"), F.col("c2").alias("c"), F.lit(True).alias("told")).distinct()
        further = state.select("raster_id", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("r2").alias("r4"), F.col("c2").alias("c4"))
        now = keep(_by_cell(_by_cell(state, told, cell, "left"), further, ["raster_id", "r2", "c2"], "left").select(*cell, (F.col("hit") | F.coalesce("told", F.lit(False))).alias("hit"), F.col("r4").alias("r2"), F.col("c4").alias("c2")))
        forget(state)
        state = now
    return state.where("hit").select(*cell)


def strahler(channel: DataFrame, edges: DataFrame) -> DataFrame:
    """raster_id, r, c, strahler: 1 at heads; where the largest upstream order meets itself, one more, else the largest.

    Order by order: a cell's order is above s just if it lies at or below a meeting of two cells whose own is at
    least s. So there are as many passes as orders (the logarithm of the number of heads at most), each
    over the cells that the one before found, and rounds of a pass are the logarithm of the longest channel.
    """
    cell = ["raster_id", "r", "c"]
    members, links, order = keep(channel.select(*cell).distinct()), keep(edges.select(*cell, "r2", "c2")), 1
    found = [members.withColumn("strahler", F.lit(1))]
    while True:
        meetings = keep(links.groupBy("raster_id", F.col("r2").alias("r"), F.col("c2").alias("c")).agg(F.count("*").alias("n")).where("n >= 2").select(*cell))
        if meetings.isEmpty():
            return reduce(DataFrame.unionByName, found).groupBy(*cell).agg(F.max("strahler").alias("strahler"))
        order += 1
        members = _downstream_of(meetings, members, links)
        found.append(members.withColumn("strahler", F.lit(order)))
        links = keep(_by_cell(links, members, cell, "left_semi"))


def coarsen(cells: DataFrame, bin_size: int) -> DataFrame:
    """raster_id, r, c, n, z: cells grouped into square bins."""
    return cells.groupBy("raster_id", F.floor(F.col("r") / bin_size).alias("r"), F.floor(F.col("c") / bin_size).alias("c")).agg(F.count("*").alias("n"), F.avg("z").alias("z"))


def coarsen_edges(edges: DataFrame, bin_size: int) -> DataFrame:
    """raster_id, r, c, r2, c2, n, w: edges between cells as edges between square bins, parallel ones counted and their w added up; edges within a bin drop out."""
    at = lambda c: F.floor(F.col(c) / bin_size).alias(c)
    binned = edges.select("raster_id", at("r"), at("c"), at("r2"), at("c2"), "w").where("r <> r2 or c <> c2")
    return binned.groupBy("raster_id", "r", "c", "r2", "c2").agg(F.count("*").alias("n"), F.sum("w").alias("w"))


def terrain_edges(cells: DataFrame, eight: bool = False) -> DataFrame:
    """raster_id, r, c, r2, c2, drop: neighbouring cells once each, 4 or 8 connected."""
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if eight else [])]
    ahead = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps))).alias("o")
    here = cells.select("raster_id", "r", "c", "z", ahead).select("raster_id", "r", "c", "z", (F.col("r") + F.col("o.a")).alias("r2"), (F.col("c") + F.col("o.b")).alias("c2"))
    return here.join(cells.select("raster_id", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("z").alias("z2")), ["raster_id", "r2", "c2"]).select("raster_id", "r", "c", "r2", "c2", (F.col("z") - F.col("z2")).alias("drop"))


def circle_votes(edges: DataFrame, radii: list[int], angles: int = 64) -> DataFrame:
    """raster_id, r, c, radius, votes: how many edge cells vote for each centre and radius."""
    shifts = sorted({(k, round(k * math.sin(2 * math.pi * a / angles)), round(k * math.cos(2 * math.pi * a / angles))) for k in radii for a in range(angles)})
    spread = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in shifts))).alias("s")
    return edges.select("raster_id", "r", "c", spread).groupBy("raster_id", (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"), F.col("s.k").alias("radius")).agg(F.count("*").alias("votes"))


def valley_grid(spark, rows: int, columns: int, raster_id: str = "valley") -> DataFrame:
    """A deterministic tilted surface with one valley and regular bumps, free of ties."""
    cells = spark.range(rows * columns).select(F.lit(raster_id).alias("raster_id"), F.floor(F.col("id") / columns).cast("int").alias("r"), (F.col("id") % columns).cast("int").alias("c"))
    return cells.withColumn("z", (rows - F.col("r")) * 0.5 + F.abs(F.col("c") - columns // 2) * 0.3 + ((F.col("r") * 7 + F.col("c") * 13) % 11) * 0.01 + (F.col("r") * columns + F.col("c")) * 1e-6)


def crater_grid(spark, rows: int, columns: int, radius: float, depth: float, rim: float, raster_id: str = "crater") -> DataFrame:
    """A bowl whose depth falls with the square of the distance from its middle, inside a rim that dies away outwards, with a small seeded roughness."""
    cells = spark.range(rows * columns).select(F.lit(raster_id).alias("raster_id"), F.floor(F.col("id") / columns).cast("int").alias("r"), (F.col("id") % columns).cast("int").alias("c"))
    d = F.sqrt(F.pow(F.col("r") - rows // 2, 2) + F.pow(F.col("c") - columns // 2, 2)) / radius
    rough = (F.pmod(F.xxhash64("r", "c"), F.lit(1000)) / 1000 - 0.5) * 0.01
    return cells.withColumn("z", F.when(d < 1, rim - (depth + rim) * (1 - d * d)).otherwise(rim * F.exp(-4 * (d - 1))) + rough)


def branching_grid(spark, rows: int, columns: int, branches: int, raster_id: str = "branching") -> DataFrame:
    """A slope down to row 0 with a main channel along the middle column and side channels that join it from both sides, `branches` in all; a cell lies higher the farther it is from the nearest channel."""
    cells = spark.range(rows * columns).select(F.lit(raster_id).alias("raster_id"), F.floor(F.col("id") / columns).cast("int").alias("r"), (F.col("id") % columns).cast("int").alias("c"))
    off = F.abs(F.col("c") - columns // 2)
    near = off.cast("double")
    for k in range(branches):
        mouth = rows * (k + 1) // (branches + 1)  # a side channel climbs by one row a column away from the main one
        side = (F.col("c") >= columns // 2) if k % 2 else (F.col("c") <= columns // 2)
        near = F.least(near, F.when(side, F.abs(F.col("r") - mouth - off) / 2).otherwise(near))
    return cells.withColumn("z", F.col("r") * 0.1 + off * 0.05 + near * 0.5 + (F.col("r") * columns + F.col("c")) * 1e-6)


def ring_landscape(spark, n: int) -> DataFrame:
    """node, loss, cost, info of n places round a ring: loss is least opposite node 0, cost rises once round, information comes in three bumps."""
    turn = 2 * math.pi * F.col("id") / n
    return spark.range(n).select(F.col("id").alias("node"), ((1 + F.cos(turn)) / 2).alias("loss"), (F.col("id") / n).alias("cost"), ((1 + F.sin(3 * turn)) / 2).alias("info"))


def drifting_field(spark, side: int, steps: int, bumps: int = 3) -> DataFrame:
    """t, x, y, value of bumps that move over a square grid of places in time and fade."""
    cells = spark.range(side * side * steps).select(F.floor(F.col("id") / (side * side)).cast("int").alias("t"), (F.floor(F.col("id") / side) % side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"))
    value = F.lit(0.0)
    for k in range(bumps):
        cx, cy = side * (k + 1) / (bumps + 1) + F.col("t") * 0.1 * (k + 1), side * (bumps - k) / (bumps + 1) - F.col("t") * 0.05 * k
        value = value + F.exp(-(F.pow(F.col("x") - cx, 2) + F.pow(F.col("y") - cy, 2)) / (2 * (k + 1.0) ** 2) - 0.02 * F.col("t"))
    return cells.withColumn("value", value)
