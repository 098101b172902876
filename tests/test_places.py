import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import places

POINT = "id long, x double, y double"


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(0).random((200, 2)) * 10


def frame(spark, p, first=0):
    return spark.createDataFrame([(first + i, float(a), float(b)) for i, (a, b) in enumerate(p)], POINT)


def test_within(spark, cloud):
    got = {(r.a, r.b) for r in places.within(frame(spark, cloud), frame(spark, cloud), 0.7).collect()}
    d = np.linalg.norm(cloud[:, None] - cloud[None], axis=2)
    assert got == {(int(i), int(j)) for i, j in np.argwhere(d <= 0.7)}


def test_nearest_in_plane(spark, cloud):
    q = np.vstack([cloud[:20], [[100.0, 100.0]]])
    got = {(r.query, r["rank"]): r.id for r in places.nearest_in_plane(frame(spark, q), frame(spark, cloud, 0), 3, 0.3).collect()}
    for i, p in enumerate(q):
        d = np.linalg.norm(cloud - p, axis=1)
        if i < 20:
            d[i] = np.inf
        else:
            d[20] = np.inf  # ids of queries and rows are one numbering
        assert [got[i, k] for k in (1, 2, 3)] == np.argsort(d)[:3].tolist()


def test_nearest_segments(spark, cloud):
    rnd = np.random.default_rng(1)
    seg = rnd.random((15, 4)) * 10
    df = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(seg)], "segment long, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: (r.segment, r.distance) for r in places.nearest_segments(frame(spark, cloud), places.cut_segments(df, 1.0), 0.5).collect()}

    def dist(p, s):
        a, b = s[:2], s[2:]
        t = np.clip(((p - a) @ (b - a)) / ((b - a) @ (b - a)), 0, 1)
        return np.linalg.norm(p - a - t * (b - a))

    for i, p in enumerate(cloud):
        d = [dist(p, s) for s in seg]
        if min(d) <= 0.5:
            assert got[i][0] == int(np.argmin(d)) and got[i][1] == pytest.approx(min(d))
        else:
            assert i not in got


def test_thinning_is_greedy(spark, cloud):
    kept = []
    for i, p in enumerate(cloud):
        if all(np.linalg.norm(p - cloud[j]) >= 0.8 for j in kept):
            kept.append(i)
    assert sorted(r.id for r in places.thin(frame(spark, cloud), 0.8).collect()) == kept


def test_traits_and_rasters(spark):
    p = frame(spark, np.array([[0.0, 0.0], [5.0, 5.0]]))
    got = {r.id: (r.trait, r.imputed) for r in places.match_traits(p, frame(spark, np.array([[0.1, 0.0], [0.2, 0.0]]), 10), 0.5).collect()}
    assert got == {0: (10, False), 1: (None, True)}
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "r int, c int, z double")
    pts = spark.createDataFrame([(1, 0.5, 2.5), (2, 2.5, 0.5), (3, 9.0, 9.0)], "id long, lon double, lat double")
    assert {r.id: r.z for r in places.raster_lookup(pts, cells, 0.0, 3.0, 1.0).collect()} == {1: 0.0, 2: 22.0}


def test_solids_and_rays(spark):
    ball = {"id": "ball", "centre": (0, 0, 0), "scale": (1, 1, 1), "shape": (1, 1)}
    far = {"id": "far", "centre": (5, 0, 0), "scale": (1, 1, 1), "shape": (1, 1)}
    pts = spark.createDataFrame([(0.5, 0.0, 0.0), (0.9, 0.9, 0.0), (5.2, 0.1, 0.0)], "x double, y double, z double")
    assert [r.solid for r in places.in_solids(pts, [ball, far]).collect()] == ["ball", None, "far"]
    rays = spark.createDataFrame([(-3.0, 0.0, 0.0, 1.0, 0.0, 0.0), (9.0, 0.0, 0.0, -1.0, 0.0, 0.0), (0.0, 3.0, 0.0, 1.0, 0.0, 0.0)], "ox double, oy double, oz double, dx double, dy double, dz double")
    hits = [(r.solid, r.t) for r in places.first_hits(rays, [far, ball]).collect()]
    assert hits == [("ball", pytest.approx(2, abs=0.05)), ("far", pytest.approx(3, abs=0.05)), (None, None)]


def test_neighbours_along_roads(spark):
    nodes = frame(spark, np.array([[0.0, 0.0], [10.0, 0.0], [20.0, 0.0]]))
    roads = spark.createDataFrame([(0, 1, 10.0), (1, 2, 10.0)], "src long, dst long, w double")
    houses = frame(spark, np.array([[0.0, 1.0], [10.0, 2.0], [20.0, 1.0]]), 100)
    got = {(r.query, r["rank"]): (r.id, r.distance) for r in places.network_neighbours(houses, nodes, roads, 1, 50.0, 5.0).collect()}
    assert got[100, 1] == (101, 13.0) and got[102, 1] == (101, 13.0) and got[101, 1] == (100, 13.0)


def test_road_neighbours_of_crowded_nodes(spark, tmp_path):
    """Two nodes equally far, whose distances differ in the last bits only: ids decide, however many are at the node that comes first by those bits."""
    import duckdb

    import __spark_entry__ as entry

    keys = [2, 50, 225, 400, *range(85 + 175 * 10, 85 + 175 * 60, 175)]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, k // 5) for k in range(25)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    c = duckdb.connect()
    for t in ("supplier", "nation"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = {tuple(r) for r in entry.queries()["road_neighbours"](spark, str(tmp_path)).select("query", "id", "rank", "distance").collect()}
    assert got == set(c.sql(entry.oracle_sql()["road_neighbours"]).fetchall()) and {i for q, i, *_ in got if q == 2} == {50, 225, 400}


def test_only_foremost_neighbours_are_joined(spark):
    """Two places of 200 houses each: as many rows as answers ask for are handed to a house, not all other houses."""
    nodes = frame(spark, np.array([[0.0, 0.0], [10.0, 0.0]]))
    roads = spark.createDataFrame([(0, 1, 10.0)], "src long, dst long, w double")
    spots = np.array([[10.0 * (i % 2), 0.001 * (i // 2)] for i in range(400)])
    near = places.network_neighbours(frame(spark, spots), nodes, roads, 2, 50.0, 5.0)
    d = np.array([[abs(p[0] - q[0]) + p[1] + q[1] for q in spots] for p in spots]) + np.where(np.eye(400), np.inf, 0)
    got = {(r.query, r["rank"]): (r.id, r.distance) for r in near.collect()}
    assert len(got) == 800
    for i in range(400):
        assert [got[i, k][0] for k in (1, 2)] == np.argsort(d[i], kind="stable")[:2].tolist() and got[i, 2][1] == pytest.approx(np.sort(d[i])[1])
    assert most_rows(near._jdf.queryExecution().executedPlan()) <= 400 * 4


def most_rows(plan):
    """Of a plan that has run: the rows that its largest join gave."""
    if "AdaptiveSparkPlan" in plan.nodeName():
        return most_rows(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return most_rows(plan.plan())
    own = plan.metrics().get("numOutputRows")
    below = plan.children()
    return max([own.get().value() if "Join" in plan.nodeName() and own.isDefined() else 0, *(most_rows(below.apply(i)) for i in range(below.size()))])


def test_required_modes(spark):
    m = spark.createDataFrame([("g", i, float(s), i == 3) for i, s in enumerate([5, 4, 3, 0])], "g string, mode int, score double, must boolean")
    assert [r.mode for r in places.required_modes(m, "g", "mode", "score", F.col("must"), 2).orderBy("rank").collect()] == [3, 0]
    assert math.isfinite(1.0)
