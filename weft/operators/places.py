"""Joins by place in the plane: nearest segments, raster cells, solids, rays, thinning and matching by distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.shapes import segment_distance, solid_inside_outside
from weft.sources.tables import forget, keep


def _around(cell: float, reach: int = 1) -> Column:
    """The cells around the cell of a point x, y."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)))
    return F.transform(steps, lambda s: F.struct((F.floor(F.col("x") / cell) + s["a"]).alias("cx"), (F.floor(F.col("y") / cell) + s["b"]).alias("cy")))


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """a, b, distance of points (id, x, y) of two tables within a radius, by an equi join on cells of that size."""
    cells = left.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), "x", "y").select("a", "xa", "ya", F.explode(_around(radius)).alias("c")).select("a", "xa", "ya", "c.cx", "c.cy")
    filed = right.select(F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    return cells.join(filed, ["cx", "cy"]).select("a", "b", d.alias("distance")).where(F.col("distance") <= radius)


def nearest_in_plane(queries: DataFrame, rows: DataFrame, k: int, cell: float) -> DataFrame:
    """query, id, rank, distance: exact k nearest points (id, x, y), by cells that widen until they hold the answer.

    A query is settled when it has k points no farther than the ring of cells reaches; the others
    go on with cells twice as wide. Ends when all are settled or cells cover everything.
    """
    left = keep(queries.select("id", "x", "y"))
    ends = rows.select("x", "y").unionByName(queries.select("x", "y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if rows.isEmpty() or ends[0] is None:
        return queries.select(F.col("id").alias("query"), F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id"), F.lit(1).alias("rank"), F.lit(0.0).alias("distance")).where(F.lit(False))
    span = max(ends[1] - ends[0], ends[3] - ends[2], cell)
    out = None
    while True:
        found = within(left, rows, cell).where("a <> b")
        ranked = keep(found.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("distance", "b"))).where(F.col("rank") <= k))
        last = cell > 1.5 * span
        settled = ranked.groupBy("a").agg(F.count("*").alias("n")).where(F.lit(last) | (F.col("n") == k)).select("a")
        part = ranked.join(settled, "a", "left_semi").select(F.col("a").alias("query"), F.col("b").alias("id"), "rank", "distance")
        out = part if out is None else out.unionByName(part)
        rest = keep(left.join(settled.withColumnRenamed("a", "id"), "id", "left_anti"))
        forget(left)
        if last or rest.isEmpty():
            return out
        left, cell = rest, cell * 2


def nearest_segments(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """id, segment, distance of the nearest segment (segment, x1, y1, x2, y2) within a radius of each point; ties to the smaller segment.

    Segments are filed in all cells that their box, widened by the radius, touches; long ones should
    be cut beforehand (see cut_segments), so that a segment's cells are few.
    """
    cell = 4 * radius
    low = lambda a, b: F.floor((F.least(a, b) - radius) / cell)
    high = lambda a, b: F.floor((F.greatest(a, b) + radius) / cell)
    grid = F.flatten(F.transform(F.sequence(low(F.col("x1"), F.col("x2")), high(F.col("x1"), F.col("x2"))), lambda i: F.transform(F.sequence(low(F.col("y1"), F.col("y2")), high(F.col("y1"), F.col("y2"))), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))
    filed = segments.select("segment", "x1", "y1", "x2", "y2", F.explode(grid).alias("c")).select("segment", "x1", "y1", "x2", "y2", "c.cx", "c.cy")
    asked = points.select("id", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    d = segment_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    near = asked.join(filed, ["cx", "cy"]).select("id", "segment", d.alias("distance")).where(F.col("distance") <= radius)
    best = near.groupBy("id").agg(F.min(F.struct("distance", "segment")).alias("m"))
    return best.select("id", "m.segment", "m.distance")


def cut_segments(segments: DataFrame, longest: float) -> DataFrame:
    """Segments cut into pieces of at most that length, under the same id."""
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) / longest)).cast("int")
    at = segments.select("segment", "x1", "y1", "x2", "y2", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    on = lambda a, b, i: a + (b - a) * i / F.col("n")
    return at.select("segment", on(F.col("x1"), F.col("x2"), F.col("i")).alias("x1"), on(F.col("y1"), F.col("y2"), F.col("i")).alias("y1"), on(F.col("x1"), F.col("x2"), F.col("i") + 1).alias("x2"), on(F.col("y1"), F.col("y2"), F.col("i") + 1).alias("y2"))


def raster_lookup(points: DataFrame, cells: DataFrame, west: float, north: float, step: float) -> DataFrame:
    """points (id, lon, lat) with the value z of their raster cell; row 0 is the northernmost. Points off the raster drop out."""
    placed = points.withColumn("c", F.floor((F.col("lon") - west) / step).cast("int")).withColumn("r", F.floor((north - F.col("lat")) / step).cast("int"))
    return placed.join(cells.select("r", "c", "z"), ["r", "c"]).drop("r", "c")


def in_solids(points: DataFrame, solids: list[dict]) -> DataFrame:
    """points (x, y, z) with the first solid that holds each: dicts of id, centre, scale, shape, axis-parallel. Box first, then the exact test.

    Solids are a parameter, a short list; a large set belongs in a table joined on cells.
    """
    if len(solids) > 1_000:
        raise ValueError("more than 1,000 solids: join them by cells instead")
    hit = F.lit(None).cast("string")
    for s in reversed(solids):
        at = [F.col(c) - float(m) for c, m in zip("xyz", s["centre"])]
        box = F.lit(True)
        for p, half in zip(at, s["scale"]):
            box = box & (F.abs(p) <= float(half))
        hit = F.when(box & (solid_inside_outside(*at, tuple(map(float, s["scale"])), tuple(map(float, s["shape"]))) <= 1), F.lit(str(s["id"]))).otherwise(hit)
    return points.withColumn("solid", hit)


def first_hits(rays: DataFrame, solids: list[dict], steps: int = 64) -> DataFrame:
    """rays (ox..oz, dx..dz) with solid and t of the first solid hit: slab test on the box, then a march through it."""
    if len(solids) > 1_000:
        raise ValueError("more than 1,000 solids: join them by cells instead")
    best = F.struct(F.lit(math.inf).alias("t"), F.lit(None).cast("string").alias("solid"))
    for s in solids:
        lo, hi = F.lit(0.0), F.lit(math.inf)
        for c, m, half in zip("xyz", s["centre"], s["scale"]):
            o, d = F.col(f"o{c}") - float(m), F.col(f"d{c}")
            a, b = (-float(half) - o) / F.nullif(d, F.lit(0.0)), (float(half) - o) / F.nullif(d, F.lit(0.0))
            missed = (d == 0) & (F.abs(o) > float(half))
            lo = F.when(missed, math.inf).otherwise(F.greatest(lo, F.coalesce(F.least(a, b), F.lit(0.0))))
            hi = F.least(hi, F.coalesce(F.greatest(a, b), F.lit(math.inf)))
        times = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: lo + (hi - lo) * k / steps)
        inside = lambda t: solid_inside_outside(*(F.col(f"o{c}") + t * F.col(f"d{c}") - float(m) for c, m in zip("xyz", s["centre"])), tuple(map(float, s["scale"])), tuple(map(float, s["shape"]))) <= 1 + 1e-9  # noqa: E731,B023
        at = F.when((lo <= hi) & (hi < math.inf), F.array_min(F.filter(times, inside)))
        best = F.when(at.isNotNull() & (at < best["t"]), F.struct(at.alias("t"), F.lit(str(s["id"])).alias("solid"))).otherwise(best)
    return rays.withColumn("hit", best).withColumn("solid", F.col("hit.solid")).withColumn("t", F.when(F.col("hit.t") < math.inf, F.col("hit.t"))).drop("hit")


def thin(points: DataFrame, radius: float) -> DataFrame:
    """Points (id, x, y) of which no two are nearer than the radius: in order of id, a point near one already kept is dropped.

    Rounds of independent choices give just the greedy result: a point is kept once no undecided
    smaller point is near it, and drops out as soon as a kept one is.
    """
    pairs = keep(within(points, points, radius).where((F.col("a") < F.col("b")) & (F.col("distance") < radius)).select("a", "b"))
    state = keep(points.select("id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        told = pairs.join(state.select(F.col("id").alias("a"), "kept"), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("kept", F.lit(False))).alias("near_kept"), F.max(F.col("kept").isNull()).alias("open"))
        verdict = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("near_kept"), False).when(~F.coalesce("open", F.lit(False)), True)
        now = keep(state.join(told, "id", "left").select("id", verdict.alias("kept")))
        forget(state)
        state = now
        if state.where("kept is null").isEmpty():
            forget(pairs)
            return points.join(state.where("kept").select("id"), "id", "left_semi")


def match_traits(points: DataFrame, traits: DataFrame, tol: float) -> DataFrame:
    """points (id, x, y) with their nearest trait row's id within tol as `trait`; unmatched points have null and `imputed` true."""
    near = within(points, traits, tol).groupBy(F.col("a").alias("id")).agg(F.min(F.struct("distance", "b")).alias("m"))
    return points.join(near, "id", "left").withColumn("trait", F.col("m.b")).withColumn("imputed", F.col("m").isNull()).drop("m")


def _foremost(rows: DataFrame, key: str, value: str, k: int, margin: float) -> DataFrame:
    """Of each key's rows (id, value): all that may be among its k smallest by value and id once something is added to
    every value and the sums are rounded. So values up to `margin` above the k-th stay, and of equal values the k smallest ids.
    """
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(value, "id"))).where(F.col("r") <= k)
    limit = first.groupBy(key).agg((F.max(value) + margin).alias("limit"))
    near = rows.join(limit, key).where(F.col(value) <= F.col("limit")).drop("limit")
    return near.withColumn("r", F.row_number().over(Window.partitionBy(key, value).orderBy("id"))).where(F.col("r") <= k).drop("r")


def network_neighbours(buildings: DataFrame, road_nodes: DataFrame, roads: DataFrame, k: int, cutoff: float, snap: float, digits: int | None = None) -> DataFrame:
    """query, id, rank, distance: k nearest buildings along roads: each building is snapped to its nearest road node, distances run over roads up to a cutoff, both snaps included.

    With `digits`, distances are rounded before they are ranked. Buildings at one node see the others in the same
    order, so each node's foremost are found once, from the foremost at each source, and never all pairs.
    """
    from weft.operators.graph import distances

    snapped = keep(within(buildings, road_nodes, snap).groupBy(F.col("a").alias("id")).agg(F.min(F.struct("distance", "b")).alias("m")).select("id", F.col("m.b").alias("node"), F.col("m.distance").alias("off")))
    # Sums that differ by more stay apart, whatever rounding does to them.
    margin = (0.0 if digits is None else 2.0 * 10.0**-digits) + 1e-14 * (cutoff + 2 * snap)
    # The k buildings nearest to one of its own lie at a node's k + 1 nearest sources, or as much farther as a snap may differ.
    way = distances(roads, snapped.select("node").distinct(), "w", cutoff, nearest=k + 1, slack=snap + margin)
    at_source = keep(_foremost(snapped.select("id", F.col("node").alias("source"), "off"), "source", "off", k + 1, margin))
    reached = way.join(at_source, "source").select("node", "id", (F.col("distance") + F.col("off")).alias("far"))
    # A query may itself be among its node's foremost: k + 1 leave k others.
    foremost = keep(_foremost(reached, "node", "far", k + 1, margin))
    total = F.col("far") + F.col("off_a")
    asked = snapped.select(F.col("id").alias("query"), "node", F.col("off").alias("off_a"))
    pairs = asked.join(foremost, "node").where("query <> id").select("query", "id", (total if digits is None else F.round(total, digits)).alias("distance"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= k).select("query", "id", "rank", "distance")


def required_modes(modes: DataFrame, key: str, mode: str, score: str, forced: Column, k: int) -> DataFrame:
    """The k modes of each key: forced ones first, then the best scores."""
    w = Window.partitionBy(key).orderBy(F.when(forced, 0).otherwise(1), F.desc(score), mode)
    return modes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def solid_statistics(points: DataFrame, solids: list[dict]) -> DataFrame:
    """solid, n, mean, std (0 for one), density of the intensity of the points in each solid; density is points over the closed-form volume."""
    from weft.functions.shapes import solid_volume

    volume = F.lit(None).cast("double")
    for s in solids:
        volume = F.when(F.col("solid") == str(s["id"]), float(solid_volume(s["scale"], s["shape"]))).otherwise(volume)
    held = in_solids(points, solids).where("solid is not null")
    return held.groupBy("solid").agg(F.count("*").alias("n"), F.avg("intensity").alias("mean"), F.coalesce(F.stddev_samp("intensity"), F.lit(0.0)).alias("std")).withColumn("density", F.col("n") / volume)
