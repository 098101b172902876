import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import spatial
from weft.operators.spatial import distance_m, locate, lon_window, near_and_inside, points_in_ring, sweep_pairs, zone_shapes

POINT = "id string, lat double, lon double"
NODE = "node_id string, geo_bbox struct<west:double,south:double,east:double,north:double>, geo_polygon array<struct<lon:double,lat:double>>, lat string"
ZONE = "zone_id string, geo_bbox struct<west:double,south:double,east:double,north:double>, geo_polygon array<struct<lon:double,lat:double>>"


def points(spark, rows):
    return spark.createDataFrame(rows, POINT)


def zones(spark, rows):
    return zone_shapes(spark.createDataFrame(rows, ZONE))


def near(df):
    return {(r.left_id, r.right_id) for r in df.collect() if r.kind == "near"}


def brute(rows, radius):
    return {(min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for b in rows[:i] if distance_m(a[1], a[2], b[1], b[2]) <= radius}


def test_near_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(f"p{i:04d}", 50 + rnd.gauss(0, 0.003), -30 + rnd.gauss(0, 0.003)) for i in range(900)]
    got = near_and_inside(points(spark, rows), zones(spark, []), 30.0, slab_locations=40)
    assert near(got) == brute(rows, 30.0) != set()
    assert got.count() == got.distinct().count()


def test_a_hot_strip_is_cut_by_longitude(spark):
    rnd = random.Random(5)
    rows = [(f"p{i:04d}", 10 + rnd.random() * 1e-4, rnd.random() * 0.1) for i in range(800)]
    assert near(near_and_inside(points(spark, rows), zones(spark, []), 30.0, slab_locations=10)) == brute(rows, 30.0)


def test_copies_of_one_place(spark):
    rows = [(f"p{i}", 1.0, 2.0) for i in range(12)] + [("q", 1.0001, 2.0)]
    assert near(near_and_inside(points(spark, rows), zones(spark, []), 30.0)) == brute(rows, 30.0)


def test_date_line_and_poles(spark):
    rows = [("a", 0.0, 179.9999), ("b", 0.0, -179.9999), ("c", 89.9999, 10.0), ("d", 89.9999, -170.0), ("e", -89.99995, 0.0), ("f", -89.99995, 90.0)]
    assert near(near_and_inside(points(spark, rows), zones(spark, []), 30.0)) == brute(rows, 30.0) == {("a", "b"), ("c", "d"), ("e", "f")}


@pytest.mark.parametrize("lat", [0, 45, 80, 89.9, -89.999])
def test_longitude_window_holds_all(lat):
    w = lon_window(lat, 30)
    for bearing in np.linspace(0, 2 * math.pi, 40):
        d = 30 / 6_371_000
        p = math.radians(lat)
        q = math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(bearing))
        x = math.degrees(math.atan2(math.sin(bearing) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q)))
        assert abs(x) <= w + 1e-9


def test_each_pair_has_one_owner():
    lat, lon, loc = np.array([0.0, 0.0001, 0.0002]), np.zeros(3), np.array(["a", "b", "c"], object)
    assert sweep_pairs(lat, lon, np.array([True, True, False]), loc, 30) == [("a", "b")]
    assert sweep_pairs(lat, lon, np.array([False, False, True]), loc, 30) == [("a", "c"), ("b", "c")]


def test_locate(spark):
    box, zero = {"west": 2.0, "south": 1.0, "east": 4.0, "north": 3.0}, {"west": 0.0, "south": 0.0, "east": 0.0, "north": 0.0}
    turned, part = {"west": 4.0, "south": 3.0, "east": 2.0, "north": 1.0}, {"west": 2.0, "south": None, "east": 4.0, "north": 3.0}
    ring = [{"lon": 0.0, "lat": 0.0}, {"lon": 2.0, "lat": 0.0}, {"lon": 2.0, "lat": 1.0}, None, {"lon": None, "lat": 9.0}]
    rows = [("box", box, ring, "x"), ("turned", turned, None, None), ("zero", zero, ring, None), ("part", part, ring, None), ("none", None, [], None), ("zero2", zero, None, None), ("box", box, ring, "again"), (None, box, None, None), ("far", {"west": 0.0, "south": 100.0, "east": 0.0, "north": 120.0}, None, None)]
    got = {r.id: (r.lat, r.lon) for r in locate(spark.createDataFrame(rows, NODE), "node_id", F.col("geo_bbox"), F.col("geo_polygon")).collect()}
    assert got == {"box": (2, 3), "turned": (2, 3), "zero": (0.5, 1), "part": (0.5, 1)}


def test_inside(spark):
    square = [{"lon": x, "lat": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))]
    notch = square[:3] + [{"lon": 2.0, "lat": 1.0}, square[3]]
    box = {"west": 4.0, "south": 4.0, "east": 0.0, "north": 0.0}
    zero = {"west": 0.0, "south": 0.0, "east": 0.0, "north": 0.0}
    z = zones(spark, [("open", None, square), ("closed", None, [*square, square[0]]), ("back", box, square[::-1]), ("twice", None, [p for p in square for _ in (0, 1)]), ("notch", box, notch), ("box", box, None), ("zero", zero, None), ("nothing", None, []), ("open", None, square), (None, box, None)])
    got = {(r.left_id, r.right_id) for r in near_and_inside(points(spark, [("in", 3.0, 2.0), ("low", 0.5, 2.0), ("out", 3.0, 5.0)]), z, 30.0).collect()}
    assert got == {("in", n) for n in ("open", "closed", "back", "twice", "box")} | {("low", n) for n in ("open", "closed", "back", "twice", "notch", "box")}


def test_ray_casting_against_winding():
    rnd = np.random.default_rng(1)
    angle = np.sort(rnd.random(9)) * 2 * math.pi
    xs, ys = np.cos(angle) * 2, np.sin(angle)
    p = rnd.normal(size=(500, 2))
    turn = np.zeros(500)
    for i in range(9):
        a, b = np.stack([xs[i] - p[:, 0], ys[i] - p[:, 1]]), np.stack([xs[i - 1] - p[:, 0], ys[i - 1] - p[:, 1]])
        turn += np.arctan2(a[0] * b[1] - a[1] * b[0], (a * b).sum(0))
    assert (points_in_ring(p[:, 0], p[:, 1], xs, ys) == (np.abs(turn) > 3)).all()


def test_empty_tables(spark):
    assert near_and_inside(points(spark, []), zones(spark, []), 30.0).count() == 0
    assert near_and_inside(points(spark, [("a", 1.0, 1.0)]), zones(spark, []), 30.0).count() == 0


def test_every_cell_is_cut_until_it_is_small(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MOST_CUTS", 8)
    rnd = random.Random(6)
    rows = [(f"p{i:04d}", 10 + rnd.random() * 0.02, rnd.random() * 0.02) for i in range(1_500)] + [(f"q{i:03d}", rnd.uniform(-60, 60), rnd.uniform(-180, 180)) for i in range(300)]
    assert near(near_and_inside(points(spark, rows), zones(spark, []), 30.0, slab_locations=20)) == brute(rows, 30.0) != set()
    d_lat = math.degrees(30 / spatial.EARTH_RADIUS_M)
    tree = spatial.cut_tree(points(spark, rows), 20, d_lat, 30.0)
    cells = tree.owner(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    assert max(np.unique(cells, return_counts=True)[1]) <= 40


def test_the_tree_finds_every_cell_that_a_box_meets():
    rnd = np.random.default_rng(2)
    tree = spatial.CutTree()
    tree.cut(0, 1, [-10.0, 0.0, 20.0])
    tree.cut(2, 2, [-50.0, 50.0])
    tree.cut(6, 1, [-5.0])
    lat, lon = rnd.uniform(-30, 30, 4_000), rnd.uniform(-100, 100, 4_000)
    cell = tree.owner(lat, lon)
    assert set(cell) == {1, 3, 4, 5, 7, 8, 9}
    south, west = rnd.uniform(-30, 30, 50), rnd.uniform(-100, 100, 50)
    box, met = tree.meet(south, south + 15, west, west + 40)
    found = set(zip(box.tolist(), met.tolist()))
    assert len(found) == len(box)
    for i in range(50):
        held = (lat >= south[i]) & (lat <= south[i] + 15) & (lon >= west[i]) & (lon <= west[i] + 40)
        assert set(cell[held].tolist()) <= {c for j, c in found if j == i}


def test_a_crowded_place_is_spread(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PLACE_IDS", 3)
    rows = [(f"p{i:02d}", 1.0, 2.0) for i in range(20)] + [(f"q{i}", 1.0001, 2.0) for i in range(7)] + [("r", 1.00005, 2.0)]
    square = [{"lon": x, "lat": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))]
    got = near_and_inside(points(spark, rows), zones(spark, [("z", None, square)]), 30.0)
    assert near(got) == brute(rows, 30.0) and got.count() == got.distinct().count()
    assert {r.left_id for r in got.collect() if r.kind == "inside"} == {r[0] for r in rows}
