"""Points near other points, and regions that contain points, on the globe.

Latitude is cut into strips at quantiles of the points. A strip that still holds too
many is cut into slabs of longitude at quantiles of its own, a slab that does into
strips again, and so on until every cell is small: a tree of cuts, one cut for about
every SLAB_LOCATIONS locations. Each cell also gets the points of a band, as wide as
the search radius, below it and on both sides, and the regions whose box meets it. A
cell is one task's work: its points are sorted by latitude and swept upwards, with an
active set ordered by longitude from which points that fell out of the radius are
dropped; each new point looks up its longitude window and verifies distances. A pair is
found where its upper point (by latitude, then key) is owned, so each pair has one owner.

Points at one and the same place are one location: the sweep sees locations, and
pairs of ids are made by joins afterwards, so that copies never meet in one task.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.grouped import map_groups
from weft.sources.tables import keep

EARTH_RADIUS_M = 6_371_000.0
#: Locations that one cell is meant to hold; cells above twice this are cut again.
SLAB_LOCATIONS = 20_000
#: Pieces that one cell is cut into at once; a larger cell is cut in several rounds.
MOST_CUTS = 1_000
#: Ids of one place that one task pairs with others; a place of more is spread over tasks.
PLACE_IDS = 1_000


def _known(*parts: Column) -> Column:
    good = F.lit(True)
    for p in parts:
        good = good & p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    return good


def box_or_none(box: Column) -> Column:
    """A box with all four sides known and not all zero, corners put in order; else null."""
    w, s, e, n = (box[k] for k in ("west", "south", "east", "north"))
    zero = (w == 0) & (s == 0) & (e == 0) & (n == 0)
    return F.when(_known(w, s, e, n) & ~zero, F.struct(F.least(w, e).alias("west"), F.least(s, n).alias("south"), F.greatest(w, e).alias("east"), F.greatest(s, n).alias("north")))


def ring_box(ring: Column) -> Column:
    """Bounding box of a ring's known vertices; null if there are none."""
    good = F.filter(ring, lambda v: v.isNotNull() & _known(v["lon"], v["lat"]))
    lons, lats = F.transform(good, lambda v: v["lon"]), F.transform(good, lambda v: v["lat"])
    return F.when(F.size(good) > 0, F.struct(F.array_min(lons).alias("west"), F.array_min(lats).alias("south"), F.array_max(lons).alias("east"), F.array_max(lats).alias("north")))


def locate(nodes: DataFrame, id_col: str, box: Column, ring: Column) -> DataFrame:
    """id, lat, lon of each id that has a place: the middle of its box, else of its ring's bounding box.

    Rows that repeat an id count once; should they differ, the smallest place in (lat, lon)
    order holds. Latitudes beyond the poles are no place; longitudes are taken modulo 360.
    """
    b = F.coalesce(box_or_none(box), ring_box(ring))
    placed = nodes.select(F.col(id_col).cast("string").alias("id"), b.alias("b")).where("id is not null and b is not null")
    lat, lon = (F.col("b.south") + F.col("b.north")) / 2, (F.col("b.west") + F.col("b.east")) / 2
    turned = F.when((lon >= -180) & (lon < 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)
    one = placed.where(F.abs(lat) <= 90).groupBy("id").agg(F.min(F.struct(lat.alias("lat"), turned.alias("lon"))).alias("p"))
    return one.select("id", "p.lat", "p.lon")


def zone_shapes(zones: DataFrame, id_col: str = "zone_id") -> DataFrame:
    """zone_id, box, xs, ys of each zone that has an area: its ring, else its box. Repeated rows count once."""
    ring = F.filter(F.col("geo_polygon"), lambda v: v.isNotNull() & _known(v["lon"], v["lat"]))
    box = box_or_none(F.col("geo_bbox"))
    has_ring = F.coalesce(F.size(ring) >= 3, F.lit(False))
    xs = F.when(has_ring, F.transform(ring, lambda v: v["lon"]))
    ys = F.when(has_ring, F.transform(ring, lambda v: v["lat"]))
    area = F.when(has_ring, ring_box(ring)).otherwise(box)
    return zones.select(F.col(id_col).cast("string").alias("zone_id"), area.alias("box"), xs.alias("xs"), ys.alias("ys")).where("zone_id is not null and box is not null").distinct()


class CutTree:
    """Cells of the globe by cuts of latitude and longitude, searched for whole batches at once.

    A node that is cut has an axis (1 latitude, 2 longitude), its cuts in one array from low to
    high, and high - low + 1 children from `child` on; a node with axis 0 is a cell.
    """

    def __init__(self):
        self.axis, self.low, self.high, self.child, self.cuts = (np.zeros(1, k) for k in ("int8", "int64", "int64", "int64", "float64"))

    def cut(self, node: int, axis: int, cuts: list[float]) -> None:
        self.axis[node], self.low[node], self.high[node], self.child[node] = axis, len(self.cuts), len(self.cuts) + len(cuts), len(self.axis)
        self.cuts = np.append(self.cuts, cuts)
        self.axis, self.low, self.high, self.child = (np.append(a, np.zeros(len(cuts) + 1, a.dtype)) for a in (self.axis, self.low, self.high, self.child))

    def _search(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Cuts at or below x of each node."""
        low, high = self.low[node].copy(), self.high[node].copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            right = open_ & (self.cuts[np.minimum(mid, len(self.cuts) - 1)] <= x)
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        return low - self.low[node]

    def owner(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.zeros(len(lat), "int64")
        while len(at := np.flatnonzero(self.axis[node])):
            n = node[at]
            node[at] = self.child[n] + self._search(n, np.where(self.axis[n] == 1, lat[at], lon[at]))
        return node

    def meet(self, south, north, west, east) -> tuple[np.ndarray, np.ndarray]:
        """Box number and cell of every cell that a box meets."""
        index, node = np.arange(len(south)), np.zeros(len(south), "int64")
        done_i, done_n = [], []
        while len(index):
            ends = self.axis[node] == 0
            done_i.append(index[ends]), done_n.append(node[ends])
            index, node = index[~ends], node[~ends]
            upright = self.axis[node] == 1
            first = self._search(node, np.where(upright, south[index], west[index]))
            last = self._search(node, np.where(upright, north[index], east[index]))
            many = last - first + 1
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            index, node = np.repeat(index, many), np.repeat(self.child[node] + first, many) + step
        return np.concatenate(done_i), np.concatenate(done_n)


def cut_tree(locations: DataFrame, slab_locations: int, d_lat: float, radius: float, parallel: int = 1) -> CutTree:
    """Cuts until no cell holds more than twice slab_locations, unless its extent is within the radius, where its pairs are that many.

    Each round counts the cells and takes quantiles of those that are too large; the driver gets
    about one cut for every slab_locations locations in all.
    """
    tree, failed, first = CutTree(), set(), True

    def celled(only: list[int] | None) -> DataFrame:
        shape, wanted = tree, None if only is None else np.array(sorted(only))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                lat, lon = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cell = shape.owner(lat, lon)
                kept = slice(None) if wanted is None else np.isin(cell, wanted)
                yield pa.RecordBatch.from_arrays([pa.array(v[kept]) for v in (cell, lat, lon)], names=["cell", "lat", "lon"])

        return locations.select("lat", "lon").mapInArrow(run, "cell long, lat double, lon double")

    while True:
        ends = [f(c).alias(f"{k}_{c}") for c in ("lat", "lon") for k, f in (("low", F.min), ("high", F.max))]
        heavy = celled(None).groupBy("cell").agg(F.count("*").alias("n"), *ends).where(F.col("n") > (0 if first else 2 * slab_locations)).collect()
        plan: dict[int, tuple] = {}
        for h in heavy:
            width = 2 * lon_window(max(abs(h["low_lat"]), abs(h["high_lat"])), radius)
            # Strips come first. Later the axis that has more room is cut, and none that a cut would only copy.
            room = {1: (h["high_lat"] - h["low_lat"]) / (2 * d_lat), 2: (h["high_lon"] - h["low_lon"]) / width}
            axes = [k for k in ((1, 2) if first else sorted(room, key=lambda k: (-room[k], k))) if (h["cell"], k) not in failed and (first or room[k] > 1)]
            if axes:
                plan[h["cell"]] = (axes[0], min(MOST_CUTS, -(-h["n"] // slab_locations) + (parallel if first else 0)), h["low_lat" if axes[0] == 1 else "low_lon"])
        if not plan:
            return tree
        for axis, column in ((1, "lat"), (2, "lon")):
            cells = [c for c in plan if plan[c][0] == axis]
            if not cells:
                continue
            grid = F.percentile_approx(column, [i / MOST_CUTS for i in range(1, MOST_CUTS)], 10 * MOST_CUTS)
            pieces = F.least(F.lit(MOST_CUTS), F.ceil(F.col("n") / slab_locations) + (parallel if first else 0))
            chosen = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.element_at("q", F.greatest(F.lit(1), F.round(i * MOST_CUTS / pieces)).cast("int")))
            for r in celled(cells).groupBy("cell").agg(F.count("*").alias("n"), grid.alias("q")).where(pieces > 1).select("cell", chosen.alias("cuts")).collect():
                cuts = sorted(set(r["cuts"]) - {plan[r["cell"]][2]})  # nothing lies below the lowest
                if cuts:
                    tree.cut(r["cell"], axis, cuts)
                    plan.pop(r["cell"])
        failed |= {(c, plan[c][0]) for c in plan}
        first = False


def lon_window(lat: float, radius: float) -> float:
    """Degrees of longitude within which all points within the radius of a point at this latitude lie."""
    angle = radius / EARTH_RADIUS_M * 1.000001
    edge = math.radians(min(90.0, abs(lat)))
    if edge + angle >= math.pi / 2 - 1e-12:
        return 180.0
    return math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(edge)))) + 1e-12


def distance_m(lat1, lon1, lat2, lon2):
    """Great-circle distance by the haversine formula; works on numbers and arrays."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def sweep_pairs(lat, lon, own, loc, radius: float) -> list[tuple[str, str]]:
    """Pairs within the radius whose upper point is owned here."""
    order = np.lexsort((loc.astype(str), lat))
    d_lat = math.degrees(radius / EARTH_RADIUS_M) * 1.000001
    cos_half = np.cos(np.radians(lat))
    lats, lons, owns, cosines = lat.tolist(), lon.tolist(), own.tolist(), cos_half.tolist()
    limit = math.sin(min(math.pi / 2, radius / (2 * EARTH_RADIUS_M))) ** 2 * (1 + 1e-9)
    active: list[tuple[float, int]] = []
    found, tail, sweep = [], 0, order.tolist()
    to_rad, sin = math.pi / 180, math.sin
    for i in sweep:
        a = lats[i]
        while lats[sweep[tail]] < a - d_lat:
            gone = sweep[tail]
            del active[bisect_left(active, (lons[gone], gone))]
            tail += 1
        if owns[i]:
            x = lons[i]
            w = lon_window(a, radius) if abs(a) < 89.9 else 180.0
            k, end, c = bisect_left(active, (x - w, -1)), len(active), cosines[i]
            while k < end:
                y, j = active[k]
                if y > x + w:
                    break
                s, t = sin((a - lats[j]) * to_rad / 2), sin((x - y) * to_rad / 2)
                if s * s + c * cosines[j] * t * t <= limit and loc[i] != loc[j] and distance_m(a, x, lats[j], y) <= radius:
                    found.append((loc[j], loc[i]))
                k += 1
        insort(active, (lons[i], i))
    return found


def points_in_ring(lon: np.ndarray, lat: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Ray casting, even-odd, straight edges in lon/lat; open or closed rings, repeated vertices and either turn do."""
    inside = np.zeros(len(lon), dtype=bool)
    for x1, y1, x2, y2 in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1)):
        if y1 != y2:
            crosses = (y1 > lat) != (y2 > lat)
            inside ^= crosses & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
    return inside


def _work(radius: float):
    def run(part, starts):
        zone_of, loc, own = part.column("zone").combine_chunks(), part.column("loc").combine_chunks(), part.column("own").to_numpy()
        lat, lon = part.column("lat").to_numpy(), part.column("lon").to_numpy()
        zoned = zone_of.is_valid().to_numpy(zero_copy_only=False)
        names = loc.to_numpy(zero_copy_only=False)
        kinds, left, right = [], [], []
        for a, b in zip(starts[:-1], starts[1:]):
            at = a + np.flatnonzero(~zoned[a:b])
            if not len(at):
                continue
            for one, two in sweep_pairs(lat[at], lon[at], own[at], names[at], radius):
                kinds.append("near"), left.append(one), right.append(two)
            mine = at[own[at]]
            if not len(mine):
                continue
            mine = mine[np.argsort(lat[mine], kind="stable")]
            plat, plon, ploc = lat[mine], lon[mine], names[mine]
            for z in a + np.flatnonzero(zoned[a:b]):
                west, south, east, north = (part.column(c)[int(z)].as_py() for c in ("west", "south", "east", "north"))
                i, j = np.searchsorted(plat, south, side="left"), np.searchsorted(plat, north, side="right")
                hit = i + np.flatnonzero((plon[i:j] >= west) & (plon[i:j] <= east))
                xs = part.column("xs")[int(z)].as_py()
                if xs is not None and len(hit):
                    hit = hit[points_in_ring(plon[hit], plat[hit], np.asarray(xs), np.asarray(part.column("ys")[int(z)].as_py()))]
                kinds += ["inside"] * len(hit)
                left += ploc[hit].tolist()
                right += [zone_of[int(z)].as_py()] * len(hit)
        return {"kind": kinds, "a": left, "b": right}

    return run


def _placed_points(tree: CutTree, d_lat: float, radius: float):
    """Copies of each location for the cells that need it: its own, those above it within the radius and those beside it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lat, lon = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            wide = np.array([lon_window(v, radius) for v in lat.tolist()])
            index, x = [np.arange(len(lat))], [lon]
            for turn in (360.0, -360.0):  # across the date line
                over = np.flatnonzero((lon + turn >= -180 - wide) & (lon + turn <= 180 + wide))
                index.append(over), x.append(lon[over] + turn)
            index, x, turned = np.concatenate(index), np.concatenate(x), np.repeat([False, True], [len(lat), sum(map(len, index[1:]))])
            box, cell = tree.meet(lat[index], lat[index] + d_lat, x - wide[index], x + wide[index])
            own = ~turned[box] & (cell == tree.owner(lat, lon)[index[box]])
            point = index[box]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own), batch.column(0).take(pa.array(point)), pa.array(lat[point]), pa.array(x[box])], names=["cell", "own", "loc", "lat", "lon"])

    return run


def _placed_zones(tree: CutTree):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            west, south, east, north = (batch.column(k).to_numpy() for k in range(1, 5))
            box, cell = tree.meet(south, north, west, east)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(batch.column(k).take(pa.array(box)) for k in range(7))], names=["cell", "zone", "west", "south", "east", "north", "xs", "ys"])

    return run


def near_and_inside(points: DataFrame, zones: DataFrame, radius: float = 30.0, slab_locations: int = SLAB_LOCATIONS) -> DataFrame:
    """kind, left_id, right_id: 'near' pairs of ids within the radius, left the smaller; 'inside' an id and a zone that holds it.

    points: id, lat, lon (see locate), zones: see zone_shapes. Defined cases: an empty
    table gives no rows of its kind; ids at the same place are near each other; a point on
    an edge of a ring belongs by the even-odd rule to one side, on an edge of a box it is
    inside; pairs across the date line and around the poles are found.
    """
    spark = points.sparkSession
    points = keep(points)
    locations = keep(points.groupBy("lat", "lon").agg(F.min("id").alias("loc"), F.count("*").alias("n")))
    d_lat = math.degrees(radius / EARTH_RADIUS_M) * 1.000001
    tree = cut_tree(locations, slab_locations, d_lat, radius, spark.sparkContext.defaultParallelism)
    placed = locations.select("loc", "lat", "lon").mapInArrow(_placed_points(tree, d_lat, radius), "cell long, own boolean, loc string, lat double, lon double")
    flat = zones.select("zone_id", "box.west", "box.south", "box.east", "box.north", "xs", "ys")
    zoned = flat.mapInArrow(_placed_zones(tree), "cell long, zone string, west double, south double, east double, north double, xs array<double>, ys array<double>")
    both = placed.unionByName(zoned.withColumn("own", F.lit(False)), allowMissingColumns=True)
    hits = keep(map_groups(both, "cell", ["zone"], _work(radius), "kind string, a string, b string").distinct())

    # Back from locations to ids. Only places with several ids need the join; a crowded place's ids are spread over several keys.
    several = locations.where("n > 1").select("loc", "lat", "lon", F.ceil(F.col("n") / PLACE_IDS).cast("int").alias("shares"))
    many = keep(several.join(points, ["lat", "lon"]).select("loc", "id", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share")))
    shares = several.select("loc", "shares")

    def with_ids(rows: DataFrame, side: str, name: str) -> DataFrame:
        spread = rows.join(shares.withColumnRenamed("loc", side), side, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
        found = spread.join(many.select(F.col("loc").alias(side), "share", F.col("id").alias(name)), [side, "share"], "left")
        return found.where(f"shares is null or {name} is not null").withColumn(name, F.coalesce(name, side)).drop("share", "shares")

    near = with_ids(with_ids(hits.where("kind = 'near'"), "a", "x"), "b", "y").select("x", "y")
    alike = many.select("loc", F.col("id").alias("x")).join(shares, "loc").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    same = alike.join(many.select("loc", "share", F.col("id").alias("y")), ["loc", "share"]).where("x < y").select("x", "y")
    pairs = near.unionByName(same).select(F.lit("near").alias("kind"), F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))
    held = with_ids(hits.where("kind = 'inside'"), "a", "x").select("kind", F.col("x").alias("left_id"), F.col("b").alias("right_id"))
    return pairs.unionByName(held)
