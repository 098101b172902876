"""Operators of the second round against NumPy, closed forms and small fixtures."""

import gzip
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import coding, filters, shapes
from weft.operators import blocks, fusion, graph, maxcal, priors, raster, sets, stats, trajectory
from weft.sources import files, tables
from weft.streaming.state import analyse_rotations, store_keyframes, stored_keyframes


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---- sets, filters, draws ----


def test_sets(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None), (None, "y")], "id long, a string"), spark.createDataFrame([(2, 5), (None, 6)], "id long, b int")
    assert sorted(map(tuple, sets.stack(a, b).collect()), key=str) == sorted([(1, "x", None), (2, None, None), (None, "y", None), (2, None, 5), (None, None, 6)], key=str)
    assert [r.id for r in sets.missing_from(a, b, ["id"]).collect()] == [1]
    assert {r.id for r in sets.known_values("id", a, b).collect()} == {1, 2}
    many = spark.range(1_000)
    few = sets.subsample(many, "id", 50, 1)
    assert few.count() == few.distinct().count() == 50 and {r.id for r in few.collect()} == {r.id for r in sets.subsample(many.repartition(7), "id", 50, 1).collect()} != {r.id for r in sets.subsample(many, "id", 50, 2).collect()}
    rows = spark.createDataFrame([(1, 2.0, "p"), (2, 5.0, "p"), (3, 5.0, None), (4, None, None), (5, 1.0, "q")], "id long, area double, cell string")
    assert [r.id for r in sets.largest(rows, 2, "area", "id").collect()] == [2, 3]
    assert {r.id: r.load for r in sets.bucket_load(rows, "cell").collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1}
    assert one(spark, sets.format_id("n-", F.lit(42), 5).alias("v")).v == "n-00042"
    labels = spark.createDataFrame([("k", "b", 1.0), ("k", "a", 1.0), ("k", "c", 3.0), ("k", None, 9.0)], "k string, l string, w double")
    assert sets.top_labels(labels, "k", "l", "w", 2).first()["labels"] == ["c", "a"]


def test_filters(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 5.0), (10.0, 5.0, 1.0), (10.1, 5.0, 1.0), (None, 1.0, 1.0)], "x double, y double, s double")
    assert [r.b for r in rows.select(filters.in_box(F.col("x"), F.col("y"), (0, 0, 10, 5)).alias("b")).collect()] == [True, True, False, False]
    assert rows.where(filters.in_region(F.col("y"), F.col("x"), F.col("s"), lats=(0, 5), sizes=(1, 1))).count() == 3
    assert rows.where(filters.in_region(F.col("y"), F.col("x"), F.col("s"), lons=(0, 10))).count() == 2


def test_draws_with_replacement(spark):
    rows = spark.range(200).select("id", (F.col("id") % 5).cast("double").alias("p")).repartition(6)
    got = maxcal.draw_with_replacement(rows, "id", 20_000, 3).toPandas()
    assert sorted(got.draw) == list(range(20_000)) and not (got.id % 5 == 0).any()
    share = got.groupby(got.id % 5).size() / 20_000
    assert all(abs(share[k] - k / 10) < 0.02 for k in range(1, 5))
    again = maxcal.draw_with_replacement(rows, "id", 20_000, 3).toPandas()
    assert (got.sort_values("draw").id.to_numpy() == again.sort_values("draw").id.to_numpy()).all()
    assert maxcal.draw_with_replacement(rows.where("p > 9"), "id", 5, 0).count() == 0


# ---- priors ----


def test_prior_sources_and_their_stack(spark):
    near = 4.0 / 111_320
    people = spark.createDataFrame(
        [("a", 0.5, 0.5, 10.2, None), ("b", 1.5, 0.5, 13.0, "a"), ("c", 0.5, 1.0 + near, 9.0, "zz"), ("d", None, None, 1.0, "b"), ("e", 0.5, 1.0 + 3 * near, None, None)], "var string, lon double, lat double, base_alt double, parent string"
    )
    square = [{"lon": float(x), "lat": float(y)} for x, y in ((0, 0), (1, 0), (1, 0.9), (0, 0.9))]
    prints = spark.createDataFrame([("z1", None, square), ("z2", None, square)], "zone_id string, geo_bbox struct<west:double,south:double,east:double,north:double>, geo_polygon array<struct<lon:double,lat:double>>")
    lines = spark.createDataFrame([("r", 0.4995, 1.0, 0.5005, 1.0)], "segment string, lon1 double, lat1 double, lon2 double, lat2 double")
    codes = spark.createDataFrame([(r, c, 1 if c == 0 else 7) for r in range(2) for c in range(2)], "r int, c int, code int")
    terrain = spark.createDataFrame([(r, c, 10.0) for r in range(2) for c in range(2)], "r int, c int, z double")
    box = (0.0, 0.0, 2.0, 2.0)
    stack = [priors.buildings(prints), priors.roads(lines), priors.land_cover(codes, box, 2, 2, {1: "water"}), priors.ground(terrain, box, 2, 2), priors.parents()]
    cats = spark.createDataFrame([(c,) for c in ("building", "road", "water", "tree", "vehicle")], "cat string")
    got = {(r.source, r["var"], r.other, r.cat, r.other_cat, r.bonus) for r in priors.factors(stack, people, cats).collect()}
    unary = {(s, v, c) for s, v, o, c, _, _ in got if o is None}
    assert {x for x in unary if x[0] == "buildings"} == {("buildings", "a", "building")}
    assert {x for x in unary if x[0] == "roads"} == {("roads", "c", "road"), ("roads", "c", "vehicle")}
    assert {x for x in unary if x[0] == "land_cover"} == {("land_cover", v, "water") for v in "ace"}
    assert {x for x in unary if x[0] == "ground"} == {("ground", "a", "road"), ("ground", "a", "water"), ("ground", "b", "building"), ("ground", "b", "tree"), ("ground", "b", "vehicle")}
    pairs = {(v, o, p, c): w for s, v, o, p, c, w in got if o is not None}
    assert {(v, o) for v, o, _, _ in pairs} == {("a", "b"), ("b", "d")} and pairs["a", "b", "water", "tree"] == -1.5 and pairs["a", "b", "road", "vehicle"] == 1.0
    flat = people.select("var").join(cats.select(F.col("cat").alias("state"))).withColumn("x", F.lit(0.0))
    told = {(r["var"], r.state): r.x for r in priors.apply(flat, priors.factors(stack, people, cats)).collect()}
    assert told["a", "building"] == 1.5 and told["a", "water"] == 2.0 and told["d", "road"] == 0.0 and len(told) == 25
    assert priors.pair_table(priors.factors(stack, people, cats)).count() == len(pairs)
    assert priors.factors([priors.buildings(prints.limit(0))], people, cats).count() == 0


# ---- masks and entities ----


def test_masks(spark):
    schema = "img long, id string, cell long"
    closed = spark.createDataFrame([(1, "a", c) for c in range(10)], schema)
    pan = spark.createDataFrame([(1, "p", c) for c in range(2, 10)] + [(1, "q", c) for c in range(8, 20)] + [(2, "r", c) for c in range(10)], schema)
    assert {(r.a, r.b): r.iou for r in fusion.mask_overlaps(pan, closed, ["img"]).collect()} == {("p", "a"): 0.8, ("q", "a"): 0.1}
    assert {r.id for r in fusion.unclaimed(pan, closed, ["img"], 0.5).select("id").distinct().collect()} == {"q", "r"}


def test_entities_of_shared_features(spark):
    rows = spark.createDataFrame([("a", "f1"), ("b", "f1"), ("b", "f2"), ("c", "f2"), ("d", None), ("e", "f3"), (None, "f1")], "n string, f string")
    assert {r.n: r.entity for r in fusion.merge_by_feature(rows, "n", "f").collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_association_by_overlap_or_centre(spark):
    box = lambda x, y, s: {"x1": x - s, "y1": y - s, "x2": x + s, "y2": y + s}
    rows = [(1, "a", box(0.5, 0.5, 0.2)), (1, "b", box(0.5, 0.5, 0.01)), (1, "c", box(0.55, 0.5, 0.2)), (1, "d", box(0.9, 0.9, 0.01)), (2, "e", box(0.5, 0.5, 0.2))]
    got = {(r.a, r.b) for r in fusion.association_pairs(spark.createDataFrame(rows, "f int, id string, box struct<x1:double,y1:double,x2:double,y2:double>"), ["f"], 0.5, 0.02).collect()}
    assert got == {("a", "b"), ("a", "c")}


# ---- fluids ----


def test_fluid_of_several_parts(spark):
    rnd = np.random.default_rng(0)
    n, parts = 8, 3
    edges = [(i, (i + 1) % n) for i in range(n)] + [(0, 4)]
    edges = sorted({(min(e), max(e)) for e in edges})
    phi = rnd.random((parts, n))
    rho = rnd.random((parts + 1, n))
    rho /= rho.sum(0)
    nodes = [(i, f"p{c}", float(rho[c, i]), float(phi[c, i])) for c in range(parts) for i in range(n)] + [(i, None, float(rho[parts, i]), None) for i in range(n)]
    got = graph.fluid_components(spark.createDataFrame(nodes, "node long, part string, rho double, phi double"), spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, length double"), 3).collect()
    src, dst = np.array(edges).T
    deg, u, x = np.bincount(np.concatenate([src, dst]), minlength=n), np.zeros((parts, len(edges))), rho.copy()
    for _ in range(3):
        head = 0.5 * x[:parts] + phi
        nu = np.zeros((parts, n))
        for c in range(parts):
            np.add.at(nu[c], dst, u[c]), np.add.at(nu[c], src, -u[c])
        nu /= deg
        u = u + 0.01 * (-(head[:, dst] - head[:, src]) - 0.8 * u + 0.15 * (nu[:, dst] - nu[:, src] - 2 * u))
        flux = (x[:parts][:, src] + x[:parts][:, dst]) / 2 * u
        for c in range(parts):
            np.add.at(x[c], dst, 0.01 * flux[c]), np.add.at(x[c], src, -0.01 * flux[c])
        x = np.maximum(x, 1e-12)
        x /= x.sum(0)
    want = {(i, f"p{c}" if c < parts else None): x[c, i] for c in range(parts + 1) for i in range(n)}
    assert {(r.node, r.part) for r in got} == set(want)
    assert all(r.rho == pytest.approx(want[r.node, r.part], abs=1e-12) for r in got)


# ---- files ----


def test_graph_streams(spark, tmp_path):
    arrays = {"edges": np.array([[0, 1], [1, 2]], "i4"), "weights": np.array([0.5, 2.0]), "positions": np.zeros((3, 2), "f4")}
    data = files.pack_stream({"nodes": 3, "beta0": 1, "modes": 2}, arrays)
    head, back = files.unpack_stream(data)
    assert head["nodes"] == 3 and head["modes"] == 2 and not head["has_cells"]
    assert all((back[k] == v).all() and back[k].dtype == v.dtype for k, v in arrays.items())
    for bad in (b"", b"KCG2" + data[4:], data[:-1], data[:40]):
        with pytest.raises(ValueError):
            files.unpack_stream(bad)
    (tmp_path / "a.kcg").write_bytes(data), (tmp_path / "b.kcg").write_bytes(data[:-3])
    rows = files.read_streams(spark, str(tmp_path)).collect()
    assert {(r.name, r.kind, tuple(r.shape)) for r in rows} == {("edges", "<i4", (2, 2)), ("weights", "<f8", (2,)), ("positions", "<f4", (3, 2))}


def test_archives(spark, tmp_path):
    np.savez_compressed(tmp_path / "x.npz", a=np.arange(6, dtype="i4").reshape(2, 3), b=np.array([1.5], "f4"))
    df = spark.createDataFrame([(1, (tmp_path / "x.npz").read_bytes()), (2, b"junk"), (3, None)], "id long, packet binary")
    assert {(r.id, r.name, r.kind, tuple(r.shape), tuple(r.data)) for r in files.unpack_archives(df, "id").collect()} == {(1, "a", "<i4", (2, 3), (0, 1, 2, 3, 4, 5)), (1, "b", "<f4", (1,), (1.5,))}


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(number, body):
    return _varint(number << 3 | 2) + _varint(len(body)) + body


@pytest.mark.parametrize("packed", [True, False])
def test_vector_tiles(spark, packed):
    zig = lambda n: n * 2 if n >= 0 else -n * 2 - 1
    commands = [1 | 1 << 3, zig(10), zig(20), 2 | 2 << 3, zig(30), zig(0), zig(0), zig(-20), 7 | 1 << 3, 1 | 1 << 3, zig(1), zig(1)]
    geometry = _message(4, b"".join(map(_varint, commands))) if packed else b"".join(_varint(4 << 3) + _varint(c) for c in commands)
    layer = _message(1, b"roads") + _message(2, _varint(3 << 3) + _varint(3) + geometry) + _varint(5 << 3) + _varint(100) + _varint(15 << 3) + _varint(2)
    tile = gzip.compress(_message(3, layer))
    rows = files.tile_features(spark.createDataFrame([(3, 1, 2, tile), (3, 1, 3, b"\x1a\xff\xff"), (3, 1, 4, b"")], "zoom_level int, tile_column int, tile_row int, tile_data binary")).collect()
    assert [(r.layer, r.feature, r.kind, r.part, [(p.x, p.y) for p in r.ring]) for r in rows] == [("roads", 0, 3, 0, [(0.1, 0.2), (0.4, 0.2), (0.4, 0.0)]), ("roads", 0, 3, 1, [(0.41, 0.01)])]


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="x"/><key id="d1" for="edge" attr.name="length"/><graph><node id="a"><data key="d0">1.5</data></node><node id="b"/><edge source="a" target="b"><data key="d1">7</data></edge></graph></graphml>')
    (tmp_path / "bad.graphml").write_text("<graphml>")
    nodes, edges = files.read_graphml(spark, str(tmp_path))
    assert {(r.id, r.data.get("x")) for r in nodes.collect()} == {("a", "1.5"), ("b", None)}
    assert [(r.src, r.dst, r.data) for r in edges.collect()] == [("a", "b", {"length": "7"})]


def test_recordings(spark, tmp_path):
    pad = lambda t, n: str(t).ljust(n).encode()
    head = pad("0", 8) + pad("", 80) + pad("", 80) + pad("01.01.31", 8) + pad("00.00.00", 8) + pad(256 * 3, 8) + pad("", 44) + pad(2, 8) + pad(1, 8) + pad(2, 4)
    columns = [("EEG", "EMG"), ("", ""), ("uV", "uV"), (-100, -1), (100, 1), (-32768, -10), (32767, 10), ("", ""), (4, 2), ("", "")]
    head += b"".join(pad(v, w) for vs, w in zip(columns, (16, 80, 8, 8, 8, 8, 8, 80, 8, 32)) for v in vs)
    (tmp_path / "r.edf").write_bytes(head + struct.pack("<12h", 0, 1, 2, 3, 10, -10, 4, 5, 6, 32767, 0, 5)), (tmp_path / "bad.edf").write_bytes(b"0" * 300)
    rows = files.read_edf(spark, str(tmp_path)).collect()
    emg = sorted((r.t, r.value) for r in rows if r.label == "EMG")
    assert emg == [(0.0, 1.0), (0.5, -1.0), (1.0, 0.0), (1.5, 0.5)]
    eeg = sorted((r.sample, r.value) for r in rows if r.label == "EEG")
    assert len(eeg) == 8 and eeg[7][1] == pytest.approx(100)


# ---- codes and solids ----


def test_quaternions(spark):
    rnd = np.random.default_rng(1)
    for trial in range(12):
        q = rnd.normal(size=4) if trial > 3 else np.eye(4)[trial]
        q /= np.linalg.norm(q)
        q = -q if q[3] < 0 else q
        x, y, z, w = q
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        got = one(spark, coding.quaternion_of(F.array(*map(F.lit, r.ravel().tolist()))).alias("q"), coding.rotation_of(F.array(*map(F.lit, q.tolist()))).alias("r"), coding.quantise_quaternion(F.array(*map(F.lit, q.tolist()))).alias("c"))
        assert np.allclose(np.abs(np.dot(got.q, q)), 1) and np.allclose(got.r, r.ravel()) and np.allclose(np.array(got.c) / 32767, q, atol=2e-5)
    assert one(spark, coding.quantise_translation(F.array(F.lit(1.2344), F.lit(-9e9), F.lit(0.0))).alias("t")).t == [1234, -(2**31) + 1, 0]


def test_spectrum_bytes(spark):
    code = [4.0, -1.0, 0.02, 0.0]
    r = one(spark, coding.spectrum_bytes(F.array(*map(F.lit, code)), F.lit(4.0)).alias("b"))
    assert r.b == "ff608180"
    back = one(spark, coding.bytes_spectrum(F.lit(r.b), F.lit(4.0)).alias("v"), coding.bytes_spectrum(F.lit(""), F.lit(4.0)).alias("e"))
    assert np.allclose(back.v, code, atol=4 / 127 / 2 + 1e-9) and back.e == []


def test_box_of_a_turned_solid(spark):
    a = math.pi / 6
    r = [math.cos(a), -math.sin(a), 0.0, math.sin(a), math.cos(a), 0.0, 0.0, 0.0, 1.0]
    lit = lambda v: F.array(*map(F.lit, v))
    got = one(spark, shapes.solid_box(lit([1.0, 2.0, 3.0]), lit([2.0, 1.0, 0.5]), lit(r)).alias("b")).b
    corners = np.array([[x, y, z] for x in (-2, 2) for y in (-1, 1) for z in (-0.5, 0.5)]) @ np.reshape(r, (3, 3)).T + [1, 2, 3]
    assert np.allclose(got.low, corners.min(0)) and np.allclose(got.high, corners.max(0))


# ---- blocks ----


def torus(n):
    at = lambda i, j: (i % n) * n + j % n
    return [("t", *t) for i in range(n) for j in range(n) for t in ((at(i, j), at(i + 1, j), at(i, j + 1)), (at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)))]


def test_laplacians_and_flows_of_a_torus(spark):
    faces = spark.createDataFrame(torus(4), "m string, a long, b long, c long")
    zeros = {r["rank"]: r.n for r in blocks.mesh_laplacians(faces, "m").where("eigenvalue < 1e-9").groupBy("rank").agg(F.count("*").alias("n")).collect()}
    assert zeros == {0: 1, 1: 2, 2: 1}
    rnd = np.random.default_rng(2)
    edges = sorted({tuple(sorted(e)) for _, a, b, c in torus(4) for e in ((a, b), (b, c), (a, c))})
    flow = spark.createDataFrame([("t", a, b, float(rnd.normal())) for a, b in edges], "m string, src long, dst long, w double")
    got = blocks.mesh_flow_parts(flow, faces, "m").join(flow, ["src", "dst"]).toPandas()
    g, c, h = (got[k].to_numpy() for k in ("gradient", "curl", "harmonic"))
    assert len(got) == 48 and np.allclose(g + c + h, got.w) and max(abs(g @ c), abs(g @ h), abs(c @ h)) < 1e-9 and np.linalg.norm(h) > 1e-3
    share = blocks.residual_share(blocks.edge_decomposition(flow, "m"), "m").first().residual
    assert share == pytest.approx(((c + h) ** 2).sum() / (got.w**2).sum())


def test_coupling_entropy(spark):
    j = {"even": np.ones((4, 4)), "diagonal": np.diag([1.0, 2, 3, 4]), "one": np.array([[5.0, 1, 0], [2, 5, 0], [0, 3, 5]])}
    rows = [(k, a, b, float(m[a, b])) for k, m in j.items() for a in range(len(m)) for b in range(len(m))]
    got = {r.kernel_id: r.entropy for r in blocks.coupling_entropy(spark.createDataFrame(rows, "kernel_id string, i long, j long, k double")).collect()}
    assert got["even"] == pytest.approx(math.log(3)) and got["diagonal"] == pytest.approx(math.log(3)) and got["one"] == pytest.approx(0)


def test_riccati_by_residual(spark):
    rnd = np.random.default_rng(4)
    rows = [(k, rnd.normal(size=9).tolist(), np.eye(3).ravel().tolist(), (np.eye(3) * 0.5).ravel().tolist(), np.eye(3).ravel().tolist()) for k in range(3)]
    df = spark.createDataFrame(rows, "s int, a array<double>, b array<double>, q array<double>, r array<double>")
    newton, closed = ({r.s: r for r in f(df, "s", 3).collect()} for f in (blocks.fit_riccati, blocks.riccati))
    assert all(np.allclose(newton[k].p, closed[k].p, atol=1e-6) and newton[k].residual < 1e-8 for k in newton)


def test_posed_solids_and_trees(spark):
    rnd = np.random.default_rng(5)
    u = rnd.normal(size=(1_500, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a = 0.7
    turn = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    p = (u * [3, 1.5, 0.8]) @ turn.T + [5, 6, 7]
    r = blocks.fit_posed_solids(spark.createDataFrame([("e", *map(float, v)) for v in p], "k string, x double, y double, z double"), "k").first()
    assert np.allclose([r.a, r.b, r.c], [3, 1.5, 0.8], rtol=0.06) and np.allclose(r.centre, [5, 6, 7], atol=0.15)
    assert abs(np.reshape(r.rotation, (3, 3))[:, 0] @ turn[:, 0]) > 0.99
    angle, height = rnd.uniform(0, 2 * math.pi, 800), rnd.uniform(0, 4, 800)
    trunk = np.stack([2 + 0.15 * np.cos(angle), 3 + 0.15 * np.sin(angle), height], 1)
    crown = u[:1_200] * [1.5, 1.5, 1.2] + [2, 3, 5]
    t = blocks.fit_trees(spark.createDataFrame([("t", *map(float, v)) for v in np.vstack([trunk, crown])], "k string, x double, y double, z double"), "k").first()
    assert abs(t.trunk_x - 2) < 0.1 and abs(t.trunk_y - 3) < 0.1 and 0.1 < t.trunk_radius < 0.25 and 3 < t.trunk_height < 4.2
    assert abs(t.crown_z - 5) < 0.3 and abs(t.crown_a - 1.5) < 0.6


def test_compression_beyond_the_bound_of_blocks(spark):
    rnd = np.random.default_rng(6)
    angle = rnd.uniform(0, 2 * math.pi, (6_000, 2))
    p = np.stack([(3 + np.cos(angle[:, 1])) * np.cos(angle[:, 0]), (3 + np.cos(angle[:, 1])) * np.sin(angle[:, 0]), np.sin(angle[:, 1])], 1)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)] + [(9_999, None, 1.0, 1.0)], "id long, x double, y double, z double").repartition(5)
    found = [blocks.compress_large(df, k, 400)[1].first() for k in (4, 40)]
    assert found[0].points == 6_000 and found[1].distortion < 0.2 < found[0].distortion
    with pytest.raises(ValueError):
        blocks.compress_large(df, 4, 5_000)


# ---- aggregates and series ----


def test_driven_dynamics(spark):
    rnd = np.random.default_rng(7)
    m, g = np.array([[0.9, 0.1], [-0.2, 0.8]]), np.array([[0.5], [1.0]])
    x, rows = np.zeros(2), []
    for t in range(200):
        u = rnd.normal(size=1)
        rows.append(("k", t, *map(float, x), float(u[0])))
        x = m @ x + g @ u
    r = stats.driven_autoregression(spark.createDataFrame(rows, "k string, t int, a double, b double, u double"), "k", ["t"], ["a", "b"], ["u"], 0.5).first()
    assert np.allclose(np.reshape(r.drift, (2, 2)), (m - np.eye(2)) / 0.5, atol=1e-6) and np.allclose(r.gain, (g / 0.5).ravel(), atol=1e-6) and r.n == 199


def test_aggregate_protocol(spark):
    rnd = np.random.default_rng(8)
    x, w = rnd.normal(size=60), rnd.random(60) + 0.1
    df = spark.createDataFrame([(i % 4, float(a), float(b)) for i, (a, b) in enumerate(zip(x, w))], "part int, x double, w double")
    parts = df.groupBy("part").agg(*stats.Moments.update(F.col("x"), F.col("w"))).withColumn("all", F.lit(1))
    r = stats.Moments.merge(parts, ["all"]).select("n", *stats.Moments.finish()).first()
    mean = (w * x).sum() / w.sum()
    assert r.n == 60 and r["mean"] == pytest.approx(mean) and r.variance == pytest.approx((w * (x - mean) ** 2).sum() / (w.sum() - 1))


def test_sliding_covariance(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(2, 25)).cumsum(1)
    df = spark.createDataFrame([("r", t, f"c{c}", float(x[c, t])) for c in range(2) for t in range(25)] + [("short", t, "c0", 1.0) for t in range(3)], "r string, t int, c string, v double")
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    got = {(r.win, r.a, r.b): r["cov"] for r in stats.sliding_covariance(df, "r", "t", "c", "v", 10, 4).collect()}
    want = {(n, f"c{a}", f"c{b}"): np.cov(z[:, s : s + 10])[a, b] for n, s in enumerate(range(0, 16, 4)) for a in range(2) for b in range(a, 2)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert trajectory.sample_windows(df.where("r = 'short'"), "r", "t", 4, 1).count() == 0


def test_fixed_vocabulary(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("a", "z", 5.0), ("b", "z", 1.0)], "k string, l string, w double")
    got = {(r.k, r.l): r.p for r in stats.label_distribution(rows, "k", "l", F.col("w"), spark.createDataFrame([("x",), ("y",), ("q",)], "label string")).collect()}
    assert got == {("a", "x"): 0.25, ("a", "y"): 0.75, ("a", "q"): 0.0, ("b", "x"): 0.0, ("b", "y"): 0.0, ("b", "q"): 0.0}


@pytest.mark.parametrize("rows", [7, 50])
def test_long_series_in_pieces(spark, rows):
    rnd = np.random.default_rng(10)
    samples = spark.createDataFrame([("a", float(t), float(rnd.normal())) for t in sorted(rnd.uniform(0, 100, 40))] + [("b", 1.0, 2.0)], "k string, t double, v double")
    grid = spark.createDataFrame([(k, float(t)) for k in "ab" for t in range(-5, 110)], "k string, t double")
    whole, cut = ({(r.k, r.t): r.value for r in trajectory.interpolate(samples, grid, "k", "t", "v", rows=n).collect()} for n in (10**6, rows))
    assert whole.keys() == cut.keys() and all(whole[k] == pytest.approx(cut[k]) for k in whole)
    long = spark.createDataFrame([("a", t, float(rnd.normal())) for t in range(3_000)] + [("b", 1, 2.0)], "k string, t int, v double")
    whole, cut = ({(r.k, r.t): r.smooth for r in trajectory.ema(long, "k", "t", "v", 0.9, bound=n).collect()} for n in (10**6, 500))
    assert whole.keys() == cut.keys() and all(whole[k] == pytest.approx(cut[k], rel=1e-12) for k in whole)


# ---- streams ----


def _stream(spark, frames, schema, folder, batches):
    size = -(-len(frames) // batches)
    for i in range(batches):
        spark.createDataFrame(frames[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def _run(df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)


def test_keyframe_store(spark, tmp_path):
    frames = [("a", n, [float(n)]) for n in range(12)]
    schema = "key string, frame long, vec array<double>"
    _run(store_keyframes(_stream(spark, frames, schema, tmp_path / "k", 4), 5), "stored", "update")
    last = spark.table("stored").toPandas().tail(5)
    assert sorted(last.frame) == [7, 8, 9, 10, 11] and set(last.stored) == {5}
    assert {r.frame for r in stored_keyframes(spark.createDataFrame(frames, schema), 5).collect()} == {7, 8, 9, 10, 11}


def test_rotations(spark, tmp_path):
    rnd = np.random.default_rng(11)
    a, b = np.array([[-0.5, 0.1], [0.0, -0.3]]), np.eye(2)
    x, rows = np.zeros(2), []
    for n in range(40):
        u = rnd.normal(size=2) * 0.1
        rows.append(("r", n, float(n), np.exp(x).tolist(), u.tolist()))
        x = x + a @ x + b @ u
    _run(analyse_rotations(_stream(spark, rows, "key string, rotation long, t double, h array<double>, u array<double>", tmp_path / "r", 4), 2, 2), "rotations", "append")
    got = spark.table("rotations").orderBy("rotation").collect()
    assert [r.status for r in got[:6]] == ["warmup"] * 5 + [got[5].status] and got[-1].status == "fitted"
    assert np.allclose(got[-1].gain, blocks.solve_riccati(a, b, 0.5 * np.eye(2), np.eye(2)).ravel(), atol=1e-3)


# ---- hooks, generators, kept tables ----


def test_segmenter_hook(spark):
    images = spark.createDataFrame([(1, [0.1, 0.9]), (2, [0.2, 0.3])], "img long, px array<double>")

    def bright(pdf, prompt):
        rows = [(i, f"{prompt}-{k}", k) for i, px in zip(pdf["img"], pdf["px"]) for k, v in enumerate(px) if v > 0.25]
        return type(pdf)(rows, columns=["img", "id", "cell"])

    got = fusion.segment(images, bright, "img long, id string, cell long", "lamp")
    assert {tuple(r) for r in got.collect()} == {(1, "lamp-1", 1), (2, "lamp-1", 1)}


def test_budget_of_expressions(spark):
    rows = spark.createDataFrame([("t", i, float(i), i % 2) for i in range(8)], "tile string, id int, area double, side int")
    got = maxcal.budgeted_pick(rows, "tile", "id", F.col("area") * 2, F.col("side").cast("string"), F.lit(1.0), 1, 9.0, 5)
    assert got.columns == rows.columns and {r.id for r in got.collect()} == {7, 6}


def test_generators(spark):
    z = {(r.r, r.c): r.z for r in raster.crater_grid(spark, 41, 41, 10.0, 5.0, 1.0).collect()}
    assert z[20, 20] == pytest.approx(-5, abs=0.01) and z[20, 30] == pytest.approx(1, abs=0.01) and abs(z[0, 0]) < 0.05
    cells = raster.branching_grid(spark, 40, 31, 3)
    d = raster.flow_direction(cells)
    wet = raster.channels(raster.flow_accumulation(d), 60)
    assert {(0, 15), (5, 15), (39 - 9, 15)} <= {(r.r, r.c) for r in wet.collect()} and wet.where("c <> 15").count() > 10


def test_kept_tables_go_with_their_scope(spark):
    import os

    outer = tables.keep(spark.range(3).toDF("id"))
    with tables.scope():
        inner = tables.keep(spark.range(5).toDF("id"))
        path = tables.kept_path(inner).removeprefix("file:")
        assert inner.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path) and outer.count() == 3


def test_many_kernels_are_not_compared_all_with_all(spark, monkeypatch):
    from weft.operators import kernels

    monkeypatch.setattr(kernels, "MOST_KERNELS", 2)
    rows = spark.createDataFrame([(str(k), 0, 0, 1.0) for k in range(3)], "kernel_id string, i long, j long, k double")
    with pytest.raises(ValueError):
        kernels.hs_distances(rows)
    assert kernels.hs_distances(rows.where("kernel_id < 2")).count() == 1
