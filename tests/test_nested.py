import json

from pyspark.sql import functions as F

from weft.operators.nested import flatten_scenes, in_steps, members, read_payload, ring_of, ring_vertices

SCHEMA = "rec_id long, sg_idx int, payload string, attrs string"
RING = [[1.5, 2.0], [3.0, 4.0], [5.0, 6.0], [1.5, 2.0]]


def scene(**node):
    return {"sg_idx": 7, "nodes": [{"id": "n1", **node}]}


def found(spark, *payloads, sg_idx=None):
    rows = [(i, sg_idx, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for i, p in enumerate(payloads)]
    t = flatten_scenes(spark.createDataFrame(rows, SCHEMA))
    return t, {tuple(r) for r in ring_vertices(t).collect()}


def test_rings_in_every_form():
    flat = [x for p in RING for x in p]
    forms = [RING, flat, [{"lon": a, "lat": b} for a, b in RING], [[str(a), str(b)] for a, b in RING], {"type": "Polygon", "coordinates": [RING]}, "POLYGON ((" + ", ".join(f"{a} {b}" for a, b in RING) + "))", json.dumps(RING), {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [RING]}}, {"type": "MultiPolygon", "coordinates": [[RING]]}]
    assert all(ring_of(f) == flat for f in forms)
    assert ring_of("POLYGON Z ((1 2 9, 3 4 9, 5 6 9))") == [1, 2, 3, 4, 5, 6]
    for none in (None, [], {}, "", "POLYGON EMPTY", [[None, None]], "nothing"):
        assert ring_of(none) == []


def test_collections_in_every_form():
    one = {"id": "c1", "source_id": "s"}
    for form in ([one], one, {"items": [one], "count": 1}, json.dumps([one])):
        assert members(form, ("id",)) == [(None, one)]
    assert members({"c1": {"score": 1}}, ("id",)) == [("c1", {"score": 1})]
    assert members(None, ("id",)) == members([], ("id",)) == members({}, ("id",)) == []


def test_same_scene_from_different_senders_is_stored_once(spark):
    a = scene(region={"id": "r1", "geo_polygon": RING}, claims=[{"id": "c1", "score": 0.5}])
    b = {"scene_graph": {"nodes": {"n1": {"claims": {"claim_id": "c1", "score": "0.5"}, "region": {"geo_polygon": json.dumps(RING), "region_id": "r1"}}}, "sg_idx": 7}}
    t, rows = found(spark, a, b, json.dumps(a), "﻿" + json.dumps({"batch": [a, b]}))
    assert rows == {(7, "n1", "region", "r1", k) for k in range(4)} | {(7, "n1", "claim", "c1", -1)}
    kinds = {r.kind: r["count"] for r in t.entries.groupBy("kind").count().collect()}
    assert kinds == {"root": 4, "scene": 1, "node": 1, "region": 1, "claim": 1, "ring": 1}
    assert t.roots.count() == 5 and t.roots.select("oid").distinct().count() == 1
    assert [tuple(r) for r in t.vertices.orderBy("vertex_no").select("lon", "lat").collect()] == [tuple(p) for p in RING]


def test_bridge_keeps_every_occurrence(spark):
    claim = {"id": "c1", "source_id": "s"}
    t, _ = found(spark, {"sg_idx": 1, "nodes": [{"id": "n1", "claims": [claim, claim]}, {"id": "n2", "claims": [claim]}]})
    assert t.claims.count() == 1
    assert sorted(r.ordinal for r in t.bridge("node").where("role = 'claim'").collect()) == [0, 0, 1]


def test_claims_under_the_region(spark):
    _, rows = found(spark, scene(region={"id": "r1", "claims": [{"id": "c1", "geo_polygon": RING[:3]}]}))
    assert rows == {(7, "n1", "region", "r1", -1)} | {(7, "n1", "claim", "c1", k) for k in range(3)}


def test_what_is_not_there(spark):
    _, rows = found(spark, None, "", "   ", "{", "[1, 2", json.dumps(scene())[:-4], scene(region=None), scene(region={}), scene(claims=None), {}, [], {"nodes": None}, {"nodes": []})
    assert rows == set()


def test_scene_number_from_the_column(spark):
    _, rows = found(spark, {"nodes": [{"id": "n1", "region": {"id": "r"}}]}, sg_idx=3)
    assert rows == {(3, "n1", "region", "r", -1)}


def test_ring_and_no_ring_both_count(spark):
    _, rows = found(spark, scene(region={"id": "r1"}), scene(region={"id": "r1", "geo_polygon": RING[:2]}))
    assert rows == {(7, "n1", "region", "r1", k) for k in (-1, 0, 1)}


def test_very_long_payload_and_deep_nesting(spark):
    long = [[float(i), 1.0] for i in range(50_000)]
    _, rows = found(spark, scene(region={"id": "r", "geo_polygon": long}), "[" * 100_000)
    assert len(rows) == 50_000


def test_rings_come_back_as_written(spark):
    rings = [[[-33.4335322, 50.1234567], [179.9999999, -89.9999999]], [[1 / 3, 2 / 3], [1e-9, 5.0]], [[500.0, 1.0]]]
    t, _ = found(spark, *(scene(region={"id": f"r{i}", "geo_polygon": r}) for i, r in enumerate(rings)))
    got = {(r.lon, r.lat) for r in t.vertices.collect()}
    assert got == {tuple(p) for r in rings for p in r}
    assert in_steps([-33.4335322]) == [-334335322] and in_steps([1 / 3]) is None and in_steps([500.0]) is None and in_steps([float("nan")]) is None


def test_odd_values(spark):
    deep = '{"nodes": [{"id": "n1", "x": ' + "[" * 600 + "]" * 600 + "}]}"
    _, rows = found(spark, '{"sg_idx": 99999999999, "nodes": [{"id": "\\ud800x", "region": {"id": 5, "area": 1e999, "score": ' + "9" * 400 + ', "geo_polygon": [[' + "9" * 400 + ', 1]]}}]}', '{"sg_idx": "4", "nodes": [{"id": "n", "region": {"id": "r", "geo_polygon": [[NaN, 1]]}}]}', deep, '{"nodes": ' + "[" * 1200 + "]" * 1200 + "}")
    assert rows == {(None, "?x", "region", "5", -1), (4, "n", "region", "r", 0)}


def test_several_values_in_a_payload():
    assert read_payload('{"a": 1}\n{"b": 2}') == [{"a": 1}, {"b": 2}]
    assert read_payload('{"a": 1}\n{"b": ') is None


def test_empty_table(spark):
    t, rows = found(spark)
    assert rows == set() and t.nodes.count() == 0 and t.roots.where(F.lit(True)).count() == 0


def test_every_arrival_keeps_its_roots(spark):
    text = json.dumps(scene(region={"id": "r1"}))
    rows = [(0, None, text, "x"), (None, None, text, "x"), (None, None, text, "x"), (0, None, text, "x"), (1, None, "{", "x"), (2, None, json.dumps([scene(), scene()]), "x")]
    t = flatten_scenes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((r.rec_id is None, r.rec_id or 0, r.ordinal) for r in t.roots.collect()) == [(False, 0, 0), (False, 0, 0), (False, 2, 0), (False, 2, 1), (True, 0, 0), (True, 0, 0)]
    assert t.scenes.count() == 2


def test_numbers_written_as_text_hash_alike_at_any_depth(spark):
    a = scene(region={"id": "r1", "geo_bbox": [1.5, 2, 3, 4], "name": "007"}, bbox={"x1": 0.1, "y1": 0.2})
    b = scene(region={"id": "r1", "geo_bbox": ["1.50", "2", 3.0, "4"], "name": "007"}, bbox={"y1": "0.20", "x1": 0.1})
    c = scene(region={"id": "r1", "geo_bbox": [1.5, 2, 3, 4], "name": "7"}, bbox={"x1": 0.1, "y1": 0.2})
    t, _ = found(spark, a, b, c)
    assert t.regions.count() == 2 and t.roots.count() == 3


def test_vertices_and_bridge_lead_back_to_every_ring(spark):
    t, rows = found(spark, scene(region={"id": "r1", "geo_polygon": RING}, claims=[{"id": "c1", "geo_polygon": RING[:3]}, {"id": "c2", "geo_polygon": [[0.123456789, 1.0]]}]))
    kids = t.bridge("region").unionByName(t.bridge("claim")).where("role = 'ring'")
    placed = kids.join(t.vertices.withColumnRenamed("oid", "child_oid"), "child_oid")
    assert placed.count() == len(rows) == 8
    assert {(r.vertex_no, r.lon, r.lat) for r in placed.collect()} == {(i, *map(float, p)) for i, p in enumerate(RING)} | {(0, 0.123456789, 1.0)}
