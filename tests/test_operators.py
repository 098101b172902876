"""Library operators against NumPy, closed forms and small fixtures."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import coding, geodesy, information, modes, motion, novelty, physics, shapes
from weft.operators import blocks, fusion, graph, kernels, maxcal, raster, stats, trajectory
from weft.plans import analytics
from weft.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def path(spark, n, graph_id="p"):
    return spark.createDataFrame([(graph_id, i, i + 1, 1.0) for i in range(n - 1)], "g string, src long, dst long, w double")


def kernel(spark, **named):
    return spark.createDataFrame([(k, i, j, float(m[i][j])) for k, m in named.items() for i in range(len(m)) for j in range(len(m))], "kernel_id string, i long, j long, k double")


# ---- kernels ----


@pytest.mark.parametrize("kind", ["linear", "cosine", "rbf", "poly", "hamming_rbf", "hellinger"])
def test_gram(spark, kind):
    rnd = np.random.default_rng(0)
    x = np.abs(rnd.normal(size=(7, 5)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "id long, vec array<double>")
    got = {(r.i, r.j): r.k for r in kernels.gram(rows.where("id < 4"), rows, kind, block=3).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    norm = np.linalg.norm(x, axis=1)
    ham = ((x > 0.5)[:, None] != (x > 0.5)[None]).sum(2)
    want = {"linear": x @ x.T, "cosine": x @ x.T / norm[:, None] / norm, "rbf": np.exp(-d2 / 2), "poly": (x @ x.T + 1) ** 3, "hamming_rbf": np.exp(-ham / 2), "hellinger": np.sqrt(x) @ np.sqrt(x).T}[kind]
    assert set(got) == {(i, j) for i in range(4) for j in range(7)}
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i, j in got)


def test_gram_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vec array<double>")
    some = spark.createDataFrame([(1, [1.0])], "id long, vec array<double>")
    assert kernels.gram(none, some, "linear").count() == kernels.gram(some, none, "linear").count() == 0


def test_kernel_norms_and_distances(spark):
    a, b = np.array([[2.0, 1], [1, 3]]), np.eye(2)
    k = kernel(spark, a=a, b=b)
    norms = {r.kernel_id: r.norm for r in kernels.hs_norm(k).collect()}
    assert norms["a"] == pytest.approx(np.linalg.norm(a) / math.sqrt(2)) and norms["b"] == pytest.approx(1)
    [d] = kernels.hs_distances(k).collect()
    assert d.distance == pytest.approx(np.linalg.norm(a - b) / math.sqrt(2))
    with pytest.raises(ValueError):
        kernels.kernel_sum(k, k, -1.0)


def test_kernel_spectra_and_projection(spark):
    bad = np.array([[1.0, 2], [2, 1]])
    k = kernel(spark, good=np.diag([3.0, 1]), bad=bad)
    got = {r.kernel_id: r for r in blocks.kernel_spectra(k).collect()}
    assert got["good"].psd and not got["bad"].psd
    assert got["good"].entropy == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25))) and got["good"].dimension == 2 and got["good"].gap == pytest.approx(2 / 3)
    fixed = blocks.project_psd(k).where("kernel_id = 'bad'").collect()
    assert all(r.k == pytest.approx(1.5) for r in fixed)
    assert blocks.log_det_change(kernel(spark, a=np.eye(2), b=4 * np.eye(2)), "a", "b").first().nats == pytest.approx(math.log(4))
    assert blocks.log_det_change(kernel(spark, a=np.eye(2), b=0.5 * np.eye(2)), "a", "b").first().nats == 0


def test_alignment_and_factorisation(spark):
    rnd = np.random.default_rng(3)
    a, b = (m @ m.T for m in rnd.normal(size=(2, 4, 4)))
    h = np.eye(4) - 0.25
    ca, cb = h @ a @ h, h @ b @ h
    [r] = blocks.alignment(kernel(spark, a=a, b=b)).collect()
    assert r.cka == pytest.approx(np.trace(ca @ cb) / math.sqrt(np.trace(ca @ ca) * np.trace(cb @ cb)))
    joint = kernel(spark, x=np.kron(a[:2, :2], b[:3, :3])).drop("kernel_id")
    parts = (kernel(spark, x=m).drop("kernel_id") for m in (a[:2, :2], b[:3, :3]))
    assert blocks.factorisation(joint, *parts, 3).first().relative == pytest.approx(0, abs=1e-9)


# ---- spectra of graphs ----


def test_path_graph_eigenvalues(spark):
    got = [r.eigenvalue for r in blocks.eigenvalues(path(spark, 8), "g").orderBy("mode").collect()]
    assert got == pytest.approx([2 * (1 - math.cos(math.pi * l / 8)) for l in range(8)], abs=1e-9)
    assert one(spark, modes.path_eigenvalue(F.lit(3), F.lit(8)).alias("x")).x == pytest.approx(got[3])


def test_mode_fixed_point(spark):
    r = one(spark, modes.fixed_point(F.lit(1.0)).alias("h"))
    assert one(spark, modes.residual(F.lit(r.h), F.lit(1.0)).alias("x")).x == pytest.approx(0, abs=1e-12)
    assert one(spark, modes.margin(F.lit(r.h)).alias("x")).x > 0


def test_spectral_state_is_self_consistent(spark):
    for r in blocks.spectral_state(path(spark, 8), "g").collect():
        assert r.h == pytest.approx(math.exp(-1 - r.eigenvalue / (2 * (1 + r.h))), abs=1e-9)
        assert r.curvature < 0


def test_heat_kernel_keeps_mass(spark):
    sums = blocks.spectral_kernel(path(spark, 6), "g", 0.7).groupBy("i").agg(F.sum("k").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)


def test_smoothing_keeps_shares(spark):
    labels = spark.createDataFrame([("p", 0, "a", 1.0), ("p", 5, "b", 1.0)], "g string, node long, cat string, p double")
    for heat in (False, True):
        got = {(r.node, r.cat): r.p for r in blocks.smooth_labels(path(spark, 6), labels, "g", 0.8, heat).collect()}
        assert got[0, "a"] > got[1, "a"] > got[4, "a"] and got[2, "a"] + got[2, "b"] == pytest.approx(1)


# ---- topology and flows ----


def test_persistence_of_collinear_points(spark):
    x = [0.0, 1.0, 3.0, 6.0]
    edges = spark.createDataFrame([("g", i, j, abs(x[i] - x[j])) for j in range(4) for i in range(j)], "g string, src long, dst long, w double")
    got = blocks.persistence_0d(edges, "g").collect()
    assert sorted(r.death for r in got if r.death is not None) == [1, 2, 3] and sum(r.death is None for r in got) == 1


def test_mesh_topology(spark):
    hollow = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)]
    disk = [(0, 1, 2), (0, 2, 3)]
    faces = spark.createDataFrame([("hollow", *f) for f in hollow] + [("disk", *f) for f in disk], "m string, a long, b long, c long")
    got = {r.m: (r.beta0, r.beta1, r.beta2) for r in blocks.mesh_topology(faces, "m").collect()}
    assert got == {"hollow": (1, 0, 1), "disk": (1, 0, 0)}


def test_edge_decomposition(spark):
    ring = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 1, 2, 1.0), ("g", 0, 2, -1.0)], "g string, src long, dst long, w double")
    for r in blocks.edge_decomposition(ring, "g").collect():
        assert r.gradient == pytest.approx(0, abs=1e-9)


def test_max_flow_and_paths(spark):
    e = spark.createDataFrame([("g", 0, 1, 3.0), ("g", 0, 2, 2.0), ("g", 1, 3, 2.0), ("g", 2, 3, 4.0), ("g", 1, 2, 1.0)], "g string, src long, dst long, w double")
    assert blocks.max_flow(e, "g", [0], [3]).first().flow == pytest.approx(5)
    assert {r.node: r.distance for r in blocks.cheapest_paths(e, "g", 0).collect()} == {0: 0, 1: 3, 2: 2, 3: 5}


def test_betweenness_and_fragmentation(spark):
    got = {r.node: r.betweenness for r in blocks.betweenness(path(spark, 5), "g").collect()}
    assert got == {0: 0, 1: 3, 2: 4, 3: 3, 4: 0}
    curve = [(r.removed, r.node, r.pairs) for r in blocks.fragmentation(path(spark, 5), "g", 2).orderBy("removed").collect()]
    assert curve == [(0, None, 10), (1, 2, 2), (2, 0, 1)] or curve[1] == (1, 2, 2)


def test_gp_posterior(spark):
    rows = spark.createDataFrame([("g", 1, 0.0, 0.0, 1.0), ("g", 2, 2.0, 0.0, -1.0), ("g", 3, 0.0, 0.0, None), ("g", 4, 50.0, 0.0, None)], "g string, id long, x double, y double, z double")
    got = {r.id: r for r in blocks.gp_posterior(rows, "g", noise=1e-3).collect()}
    assert got[3].mean == pytest.approx(1, abs=1e-3) and got[3].std < 0.01
    assert got[4].mean == pytest.approx(0, abs=1e-6) and got[4].std == pytest.approx(1)


def test_riccati():
    a, b, q, r = np.array([[0.0, 1], [0, 0]]), np.array([[0.0, 0], [0, 1]]), np.eye(2), np.eye(2)
    p = blocks.solve_riccati(a, b, q, r)
    assert np.allclose(p, [[math.sqrt(3), 1], [1, math.sqrt(3)]], atol=1e-8)


def test_solids_and_codes(spark):
    rnd = np.random.default_rng(0)
    v = rnd.normal(size=(300, 3))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * [2, 1, 0.5]
    df = spark.createDataFrame([("s", *map(float, p)) for p in v], "s string, x double, y double, z double")
    r = blocks.fit_solids(df, "s").first()
    assert (r.a, r.b, r.c) == pytest.approx((2, 1, 0.5), abs=0.1) and r.loss < 1e-2
    coded = blocks.cosine_code(spark.createDataFrame([(1, [1.0, 2.0, 4.0, 1.0]), (2, [])], "id long, v array<double>"), "id", "v", 4)
    assert coded.where("id = 1").first().rebuilt == pytest.approx([1, 2, 4, 1])
    assert shapes.solid_volume((1, 1, 1), (1, 1)) == pytest.approx(4 / 3 * math.pi)


def test_attention_state(spark):
    r = blocks.attention_state(kernel(spark, h=np.full((4, 4), 0.25)), "kernel_id").first()
    assert r.fiedler == pytest.approx(1.0)


def test_compression_keeps_all_with_all_modes(spark):
    pts = spark.createDataFrame([("m", i, float(i % 3), float(i // 3), 0.0) for i in range(9)], "m string, id long, x double, y double, z double")
    edges = spark.createDataFrame([("m", i, i + 1, 1.0) for i in range(8)], "m string, src long, dst long, w double")
    assert blocks.compress_points(pts, edges, "m", 9).first().distortion == pytest.approx(0, abs=1e-9)
    assert 0 < blocks.compress_points(pts, edges, "m", 3).first().distortion < 1


# ---- graphs ----


def test_nearest(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(60, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(5)
    got = {(r.query, r["rank"]): r.id for r in graph.nearest(rows, rows, 4, block=25).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(d[i])[:4])}
    assert got == want


def test_components_and_betti(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node long")
    edges = graph.canonical(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 0), (30, 31), (31, 30), (5, 5), (None, 3)], "src long, dst long"))
    assert graph.betti(nodes, edges).first().asDict() == {"n": 40, "e": 22, "beta0": 19, "beta1": 1}
    assert {r.component for r in graph.components(nodes, edges).where("node <= 20").collect()} == {0}
    assert graph.pairwise_connectivity(graph.components(nodes, edges)).first().pairs == 21 * 20 // 2 + 1


def test_fluid_against_numpy(spark):
    n = 12
    e = sorted({tuple(sorted((i, (i + 1) % n))) for i in range(n)} | {(2, 9)})
    rho, loss, cost, info = np.full(n, 1 / n), np.arange(n) / n, np.cos(np.arange(n)), np.ones(n)
    d = np.zeros((len(e), n))
    for k, (i, j) in enumerate(e):
        d[k, i], d[k, j] = -1, 1
    deg, u, phi, x = np.abs(d).sum(0), np.zeros(len(e)), loss + 1.2 * cost - 0.9 * info, rho.copy()
    for _ in range(3):
        u = u + 0.01 * (-(d @ (0.5 * x + phi)) - 0.8 * u + 0.15 * (d @ ((d.T @ u) / deg) - 2 * u))
        x = np.maximum(x + 0.01 * (d.T @ (np.abs(d) @ x / 2 * u)), 1e-12)
        x /= x.sum()
    nodes = spark.createDataFrame([(i, float(rho[i]), float(loss[i]), float(cost[i]), float(info[i])) for i in range(n)], "node long, rho double, loss double, cost double, info double")
    edges = spark.createDataFrame([(i, j, 1.0) for i, j in e], "src long, dst long, length double")
    got = {r.node: r.rho for r in graph.fluid(nodes, edges, 3)[0].collect()}
    assert [got[i] for i in range(n)] == pytest.approx(x.tolist(), abs=1e-12)


def test_mixing(spark):
    edges = graph.canonical(spark.createDataFrame([(i, (i + 1) % 9) for i in range(9)], "src long, dst long"))
    m = graph.metropolis(edges).cache()
    v = spark.createDataFrame([(i, float(i)) for i in range(9)], "node long, v double")
    assert graph.mix(m, v).agg(F.sum("v")).first()[0] == pytest.approx(36)
    second = float(np.sort(np.abs(np.linalg.eigvalsh(np.array([[next((r.p for r in m.collect() if (r.i, r.j) == (i, j)), 0.0) for j in range(9)] for i in range(9)]))))[-2])
    assert graph.chebyshev_mix(m, v, second, 3).count() == 9


# ---- rasters ----


def test_flow_on_a_slope(spark):
    cells = spark.createDataFrame([("s", r, c, 10.0 - r - 0.1 * c) for r in range(4) for c in range(3)] + [("s", 9, 9, None), ("s", 8, 8, float("nan"))], "raster_id string, r int, c int, z double")
    d = raster.flow_direction(cells).cache()
    assert {(r.r, r.c): r.direction for r in d.collect()}[3, 2] == -1
    acc = raster.flow_accumulation(d).cache()
    assert acc.agg(F.max("accumulation")).first()[0] <= 12 and acc.where("accumulation < 1").count() == 0
    pits = acc.join(d.where("direction = -1"), ["raster_id", "r", "c"])
    assert pits.agg(F.sum("accumulation")).first()[0] == 12


def test_flat_is_a_pit(spark):
    cells = spark.createDataFrame([("f", r, c, 1.0) for r in range(2) for c in range(2)], "raster_id string, r int, c int, z double")
    assert [r.direction for r in raster.flow_direction(cells).collect()] == [-1] * 4


def test_strahler(spark):
    flows = [(0, 0, 1, 1), (0, 2, 1, 1), (1, 1, 2, 1), (2, 0, 3, 1), (2, 1, 3, 1), (2, 3, 3, 3), (2, 4, 3, 3), (3, 1, 4, 2), (3, 3, 4, 2)]
    edges = spark.createDataFrame([("s", *f) for f in flows], "raster_id string, r int, c int, r2 int, c2 int")
    cells = edges.select("raster_id", "r", "c").union(edges.select("raster_id", "r2", "c2")).distinct()
    got = {(r.r, r.c): r.strahler for r in raster.strahler(cells, edges).collect()}
    assert got == {(0, 0): 1, (0, 2): 1, (1, 1): 2, (2, 0): 1, (2, 1): 2, (3, 1): 2, (2, 3): 1, (2, 4): 1, (3, 3): 2, (4, 2): 3}


@pytest.fixture
def kept_plans(monkeypatch):
    """The plans of the tables that raster operators keep."""
    plans, real = [], raster.keep
    monkeypatch.setattr(raster, "keep", lambda df, *by: (plans.append(plan_of(df)), real(df, *by))[1])
    return plans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strahler_builds_no_cells_on_the_driver(spark, kept_plans):
    """However small Spark takes them for: a valley of 864,000 cells is a few MB as a file."""
    d = tables.keep(raster.flow_direction(raster.valley_grid(spark, 40, 36)))
    wet = tables.keep(raster.channels(raster.flow_accumulation(d), 12))
    raster.strahler(wet, raster.drainage_edges(d, wet))
    assert sum("Join" in p for p in kept_plans) > 5 and not any("Broadcast" in p for p in kept_plans)


def test_drainage_builds_no_cells_on_the_driver(spark):
    d = tables.keep(raster.flow_direction(raster.valley_grid(spark, 40, 36)))
    plan = plan_of(raster.drainage_edges(d, tables.keep(raster.channels(raster.flow_accumulation(d), 12))))
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def nodes_run(spark, query, root):
    """Node names of all plans of a query as they ran, after adaptive execution planned them anew."""
    sc, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    sc.listenerBus().waitUntilEmpty(30_000)
    before = {x.executionId() for x in listed(store.executionsList())}
    getattr(analytics, query)(spark, root).collect()
    sc.listenerBus().waitUntilEmpty(30_000)
    return [n.name() for x in listed(store.executionsList()) if x.executionId() not in before for n in listed(store.planGraph(x.executionId()).allNodes())]


def test_drainage_as_run_broadcasts_nothing(spark, data):
    """1,440 cells are far below Spark's threshold, and yet every join sorts."""
    names = nodes_run(spark, "drainage_network", data)
    assert names.count("SortMergeJoin") > 10 and not any("Broadcast" in n for n in names)


def test_accumulation_builds_no_cells_on_the_driver(spark, kept_plans):
    d = raster.flow_direction(raster.valley_grid(spark, 40, 36))
    assert "Join" not in plan_of(d)
    raster.flow_accumulation(tables.keep(d))
    assert len(kept_plans) > 5 and all("SortMergeJoin" in p and "Broadcast" not in p for p in kept_plans)


def test_accumulation_as_run_broadcasts_nothing(spark, data):
    names = nodes_run(spark, "flow_accumulation", data)
    assert names.count("SortMergeJoin") > 10 and not any("Broadcast" in n for n in names)


def test_curvature_of_a_bowl(spark):
    cells = spark.createDataFrame([("b", r, c, float((r - 4) ** 2 + (c - 4) ** 2)) for r in range(9) for c in range(9)], "raster_id string, r int, c int, z double")
    got = {(r.r, r.c): r.planform for r in raster.curvature(cells).collect()}
    assert got[4, 4] == pytest.approx(4)
    assert raster.terrain_edges(cells).count() == 2 * 9 * 8 and raster.terrain_edges(cells, True).count() == 2 * 9 * 8 + 2 * 64
    assert raster.coarsen(cells, 3).count() == 9


def test_circle_votes(spark):
    ring = {(round(10 + 5 * math.sin(a / 20)), round(10 + 5 * math.cos(a / 20))) for a in range(126)}
    votes = raster.circle_votes(spark.createDataFrame([("c", r, c) for r, c in ring], "raster_id string, r int, c int"), [4, 5, 6]).orderBy(F.desc("votes")).first()
    assert (votes.r, votes.c, votes.radius) == (10, 10, 5)


# ---- choices and fusion ----


def test_maxcal_meets_its_targets(spark):
    rnd = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rnd.normal(size=(200, 2)))], "id long, a double, b double")
    lam = maxcal.fit(rows, [F.col("a"), F.col("b")], [0.3, -0.2])
    p = maxcal.distribution(rows, [F.col("a"), F.col("b")], lam).cache()
    got = p.agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("a")).alias("a"), F.sum(F.col("p") * F.col("b")).alias("b")).first()
    assert (got.s, got.a, got.b) == pytest.approx((1, 0.3, -0.2), abs=1e-8)
    assert maxcal.entropy(p).first().entropy < math.log(200)
    assert maxcal.draw(p, "id", 20, 1).select("id").distinct().count() == 20
    with pytest.raises(ValueError):
        maxcal.fit(rows, [F.col("a")], [100.0])


def test_budgeted_pick_skips_and_goes_on(spark):
    rows = [("f", 1, 9.0, "x", 5.0), ("f", 2, 8.0, "x", 1.0), ("f", 3, 7.0, "x", 1.0), ("f", 4, 6.0, None, 9.0), ("f", 5, 5.0, "y", 2.0)]
    df = spark.createDataFrame(rows, "frame string, id long, value double, bucket string, cost double")
    assert sorted(r.id for r in maxcal.budgeted_pick(df, "frame", "id", "value", "bucket", "cost", 2, 9.0, 10).collect()) == [1, 2, 5]


def brute_marginals(unary, pairs, cost):
    import itertools

    names = sorted(unary)
    total = {n: np.zeros(len(unary[n])) for n in names}
    for states in itertools.product(*(range(len(unary[n])) for n in names)):
        at = dict(zip(names, states))
        e = sum(unary[n][at[n]] for n in names) - sum(w * cost[at[a]][at[b]] for a, b, w in pairs)
        for n in names:
            total[n][at[n]] += math.exp(e)
    return {n: v / v.sum() for n, v in total.items()}


def test_belief_propagation_on_a_tree(spark):
    rnd = np.random.default_rng(5)
    unary = {n: rnd.normal(size=3) for n in "abcd"}
    pairs, cost = [("a", "b", 0.7), ("b", "c", 1.2), ("b", "d", 0.4)], [[0, 0.5, 1], [0.5, 0, 1], [1, 1, 0]]
    u = spark.createDataFrame([(n, k, float(x)) for n, v in unary.items() for k, x in enumerate(v)], "var string, state int, x double")
    p = spark.createDataFrame(pairs, "a string, b string, weight double")
    t = spark.createDataFrame([(i, j, float(cost[i][j])) for i in range(3) for j in range(3)], "s int, t int, cost double")
    got = {(r["var"], r.state): r.p for r in fusion.belief_propagation(u, p, t, rounds=12, damping=0.0, tol=1e-9).collect()}
    for n, v in brute_marginals(unary, pairs, cost).items():
        assert [got[n, k] for k in range(3)] == pytest.approx(v.tolist(), abs=1e-6)


def test_belief_propagation_in_frames(spark):
    rnd = np.random.default_rng(6)
    cost = [[0, 0.5, 1], [0.5, 0, 1], [1, 1, 0]]
    rows, links, alone = [], [], {}
    for f in range(4):
        names = [f"{f}{c}" for c in "abcd"]
        unary = {n: rnd.normal(size=3) for n in names}
        pairs = [(names[0], names[1], 0.7), (names[1], names[2], 1.2), (names[1], names[3], 0.4)]
        rows += [(f if f < 3 else None, n, k, float(x)) for n, v in unary.items() for k, x in enumerate(v)]
        links += [(f if f < 3 else None, *p) for p in pairs]
        alone |= brute_marginals(unary, pairs if f < 3 else [], cost)  # without a frame there are no pairs
    links += [(0, "0a", "0a", 5.0), (0, "0a", "nobody", 5.0), (1, "0a", "1a", 5.0)]
    u = spark.createDataFrame(rows, "frame int, var string, state int, x double")
    p = spark.createDataFrame(links, "frame int, a string, b string, weight double")
    t = spark.createDataFrame([(i, j, float(cost[i][j])) for i in range(3) for j in range(3)], "s int, t int, cost double")
    for most in (100, 3):  # beyond the bound frames go through tables
        known = p if most == 100 else p.where("b <> 'nobody' and (frame <> 1 or a <> '0a')")
        got = {(r["var"], r.state): r.p for r in fusion.belief_propagation_in_frames(u, known, t, rounds=14, damping=0.0, tol=1e-9, most=most).collect()}
        assert len(got) == 48
        for n, v in alone.items():
            assert [got[n, k] for k in range(3)] == pytest.approx(v.tolist(), abs=1e-6)
    assert fusion.belief_propagation_in_frames(u.limit(0), p, t).count() == 0


def test_rounds_that_end_before_the_tolerance_are_reported(spark):
    u = spark.createDataFrame([(n, k, float(k * (n == "a"))) for n in "abc" for k in range(2)], "var string, state int, x double")
    p = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "a string, b string, weight double")
    t = spark.createDataFrame([(i, j, float(i != j)) for i in range(2) for j in range(2)], "s int, t int, cost double")
    with pytest.warns(RuntimeWarning, match="after 4 rounds"):
        fusion.belief_propagation(u, p, t, rounds=4)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        fusion.belief_propagation(u, p, t)


@pytest.mark.parametrize("name, operator", [("loopy_bp", "belief_propagation_in_frames"), ("source_weights", "fit_sources")])
def test_registered_iterations_run_the_default_rounds(spark, data, monkeypatch, name, operator):
    import __spark_entry__ as entry

    real, given = getattr(fusion, operator), []
    monkeypatch.setattr(fusion, operator, lambda *args, **named: given.append(named) or real(*args, **named))
    entry.queries()[name](spark, data)
    assert given == [{}]


def test_posterior_without_evidence_is_uniform(spark):
    claims = spark.createDataFrame([("n", "nobody", "x", 1.0), ("m", "s", "a", 1.0)], "node_id string, source_id string, native_label string, score double")
    cats = spark.createDataFrame([("a",), ("b",)], "cat string")
    prior = spark.createDataFrame([("s", "a", "a", 0.9), ("s", "a", "b", 0.1)], "source string, label string, cat string, q double")
    got = {(r.node_id, r.cat): r.p for r in fusion.posteriors(claims, prior, None, ["node_id"], cats).collect()}
    assert got == pytest.approx({("n", "a"): 0.5, ("n", "b"): 0.5, ("m", "a"): 0.9, ("m", "b"): 0.1})


def test_box_pairs_with_huge_boxes(spark):
    box = lambda a, b, c, d: {"x1": a, "y1": b, "x2": c, "y2": d}
    rows = [("f", "a", box(0.0, 0.0, 90.0, 90.0)), ("f", "b", box(0.0, 0.0, 90.0, 89.0)), ("f", "c", box(0.0, 0.0, 0.01, 0.01)), ("f", "d", box(0.0, 0.0, 0.01, 0.011)), ("g", "e", box(0.0, 0.0, 0.01, 0.01))]
    df = spark.createDataFrame(rows, "f string, id string, box struct<x1:double,y1:double,x2:double,y2:double>")
    got = fusion.iou_pairs(df, ["f"], 0.5).collect()
    assert {(r.a, r.b) for r in got} == {("a", "b"), ("c", "d")} and len(got) == 2


def test_claim_clusters(spark):
    box = lambda a, b: {"x1": a, "y1": 0.0, "x2": b, "y2": 1.0}
    rows = [("f", "a", box(0, 10), 10.0), ("f", "b", box(1, 10), 9.0), ("f", "c", box(0, 5), 5.0), ("f", "d", box(20, 22), 2.0)]
    df = spark.createDataFrame([(f, i, {k: float(v) for k, v in b.items()}, a) for f, i, b, a in rows], "f string, claim_id string, box struct<x1:double,y1:double,x2:double,y2:double>, area double")
    assert {r.claim_id: r.cluster for r in fusion.cluster_claims(df, ["f"], 0.5).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}


# ---- columns ----


def test_columns(spark):
    v = F.array(*map(F.lit, (4.0, 2.0, 2.0, 0.0)))
    r = one(
        spark, information.spectral_entropy(v).alias("raw"), information.spectral_entropy(v, True).alias("norm"), information.nonzero_entropy(v).alias("nz"), information.von_neumann_entropy(v).alias("vn"), information.effective_dimension(v).alias("dim"), information.head_entropy(v, 3).alias("head"),
        information.hellinger_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("h"), information.relative_entropy(v, v).alias("kl"), novelty.spectral_signal(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(True)).alias("zero"), novelty.spectral_signal(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(False)).alias("absent"),
        motion.novelty_factor(F.lit(0.01)).alias("safe"), motion.novelty_factor(F.lit(2.0)).alias("danger"), physics.landauer_joules(F.lit(1.0)).alias("j"), coding.detail_level(F.lit(9.0), F.lit(1), F.lit(5), 5, 3, 1).alias("level"), coding.detail_level(F.lit(0.0), F.lit(1), F.lit(5), 5, 3, 1).alias("skeleton"), geodesy.utm_zone(F.lit(-30.5)).alias("zone"),
        shapes.segment_distance(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("seg"), shapes.solid_inside_outside(F.lit(1.0), F.lit(0.0), F.lit(0.0), (1, 1, 1), (1, 1)).alias("io"),
    )
    raw = -(0.5 * math.log(0.5) + 2 * 0.25 * math.log(0.25))
    assert (r.raw, r.norm, r.nz) == pytest.approx((raw, raw / math.log(4), raw / math.log(3)))
    assert r.vn == pytest.approx(raw, abs=1e-8) and r.dim == 3 and r.head == pytest.approx(math.log(2), abs=1e-9)
    assert (r.h, r.kl, r.zero, r.absent) == pytest.approx((1, 0, 0.875, 0))
    assert (r.safe, r.danger, r.level, r.skeleton, r.zone, r.seg, r.io) == (1.0, pytest.approx(0.1), "patch_request", "skeleton_only", 25, 1.0, 1.0)
    assert r.j == pytest.approx(4.116e-21, rel=1e-3)


def test_quantisers_and_prompts(spark):
    for x, code in ((0.0, 0), (1.0, 255), (2.0, 255), (-1.0, 0), (float("nan"), 0), (None, 0)):
        assert one(spark, coding.quantise_unsigned(F.lit(x).cast("double"), 1, 0.0, 1.0).alias("c")).c == code
    assert one(spark, coding.quantise_signed(F.lit(-9.0), 1, -1.0, 1.0).alias("c")).c == -127
    r = one(spark, coding.prompt_of(F.array(F.lit(" tree"), F.lit(None), F.lit("car"))).alias("p"), coding.labels_of(F.lit("tree. car.")).alias("l"))
    assert r.p == "tree. car." and r.l == ["tree", "car"]


def test_moments(spark):
    rows = [("a", 1e9 + i, 1.0 + i % 3) for i in range(50)] + [("a", None, 1.0), ("a", float("nan"), 1.0), ("a", 5.0, 0.0), ("a", float("inf"), 1.0), ("b", 2.0, 1.0)]
    got = {r.k: r for r in stats.weighted_moments(spark.createDataFrame(rows, "k string, x double, w double"), ["k"], F.col("x"), F.col("w")).collect()}
    x, w = np.array([1e9 + i for i in range(50)]), np.array([1.0 + i % 3 for i in range(50)])
    m = (w * x).sum() / w.sum()
    assert got["a"].n == 50 and got["a"].mean == pytest.approx(m, rel=1e-15) and got["a"].variance == pytest.approx((w * (x - m) ** 2).sum() / (w.sum() - 1), rel=1e-9)
    assert got["b"].variance == 0


def test_interpolation_is_clamped(spark):
    s = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0), ("a", 3.0, 50.0)], "k string, t double, v double")
    g = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 2.0, 3.0, 9.0)] + [("b", 1.0)], "k string, t double")
    assert {(r.k, r.t): r.value for r in trajectory.interpolate(s, g, "k", "t", "v").collect()} == {("a", 0.0): 10, ("a", 1.0): 10, ("a", 2.0): 25, ("a", 3.0): 40, ("a", 9.0): 40, ("b", 1.0): None}


def test_autoregression(spark):
    m = np.array([[0.9, 0.1], [-0.2, 0.8]])
    x, rows = np.array([1.0, 2.0]), []
    for t in range(30):
        rows.append(("a", t, *map(float, x)))
        x = m @ x
    r = stats.autoregression(spark.createDataFrame(rows, "k string, t int, u double, v double"), "k", "t", ["u", "v"], 0.5).first()
    assert r.drift == pytest.approx(((m - np.eye(2)) / 0.5).ravel().tolist(), abs=1e-6)
