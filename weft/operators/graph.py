"""Graphs as edge tables src < dst with weight w: neighbours, components, flows and mixing.

Loops keep their state as a table in the shared folder after each round, so that
lineage stays short and a lost executor costs one round. Only counts reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.sources.tables import forget, keep


#: Keys that one node's or component's rows are spread over where many may meet.
SALTS = 8


def canonical(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Distinct edges src < dst; self-loops and rows with a null end drop out, parallel edges keep the largest weight."""
    weight = F.col("w") if "w" in edges.columns else F.lit(1.0)
    return edges.where(f"{a} <> {b}").select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), weight.alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", block: int = 1024) -> DataFrame:
    """query, id, rank, distance: the k nearest other rows of each query, exact, ties to the smaller id.

    Queries are broadcast in blocks; each partition of rows keeps its own k best for each query,
    so only k rows for each query and partition are shuffled.
    """
    from weft.operators.kernels import _sq_dist, _vectors

    spark = rows.sparkSession
    known = queries.where(f"{vec_col} is not null").select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"))
    source = rows.where(f"{vec_col} is not null").select(F.col(id_col).cast("long").alias("j"), F.col(vec_col).cast("array<double>").alias("v"))

    def best_of(ids, matrix):
        shared = spark.sparkContext.broadcast((np.array(ids, "int64"), np.array(matrix)))

        def run(batches):
            import pyarrow as pa

            own, q = shared.value
            top_d, top_j = np.full((len(own), k), np.inf), np.full((len(own), k), np.iinfo("int64").max)
            for batch in batches:
                for a in range(0, len(batch), 4096):
                    part = batch.slice(a, 4096)
                    j = part.column(0).to_numpy()
                    d = _sq_dist(q, _vectors(part.column(1)))
                    d[own[:, None] == j[None, :]] = np.inf
                    all_d, all_j = np.concatenate([top_d, d], 1), np.concatenate([top_j, np.tile(j, (len(own), 1))], 1)
                    order = np.lexsort((all_j, all_d), axis=1)[:, :k]
                    top_d, top_j = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_j, order, 1)
            some = np.isfinite(top_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)[some.ravel()]), pa.array(top_j[some]), pa.array(np.sqrt(top_d[some]))], names=["query", "id", "distance"])

        return source.mapInArrow(run, "query long, id long, distance double")

    out, ids, matrix = None, [], []
    for r in known.toLocalIterator():
        ids.append(r.i), matrix.append(r.v)
        if len(ids) == block:
            out = best_of(ids, matrix) if out is None else out.unionByName(best_of(ids, matrix))
            ids, matrix = [], []
    if ids:
        out = best_of(ids, matrix) if out is None else out.unionByName(best_of(ids, matrix))
    if out is None:
        return source.select(F.lit(0).cast("long").alias("query"), F.col("j").alias("id"), F.lit(1).alias("rank"), F.lit(0.0).alias("distance")).where(F.lit(False))
    w = Window.partitionBy("query").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "rank", "distance")


def gaussian_edges(near: DataFrame, sigma: float, halved: bool = True) -> DataFrame:
    """Undirected edges of a neighbour table with weights exp(-d^2 / 2 sigma^2), or without the 2; either direction's larger weight."""
    w = F.exp(-F.col("distance") * F.col("distance") / ((2.0 if halved else 1.0) * sigma * sigma))
    return canonical(near.select(F.col("query").alias("src"), F.col("id").alias("dst"), w.alias("w")))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree (number of edges), strength (sum of weights)."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def laplacian(edges: DataFrame) -> DataFrame:
    """i, j, k: nonzero cells of the combinatorial Laplacian."""
    off = both_ways(edges).select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("k"))
    return off.unionByName(degrees(edges).select(F.col("node").alias("i"), F.col("node").alias("j"), F.col("strength").alias("k")))


def dirichlet_energy(edges: DataFrame, values: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """energy: sum over edges of w |x_i - x_j|^2 over the number of nodes times columns."""
    cols = [F.col(c).cast("double") for c in columns]
    a = values.select(F.col(node).alias("src"), F.array(*cols).alias("a"))
    b = values.select(F.col(node).alias("dst"), F.array(*cols).alias("b"))
    d = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    total = edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum(F.col("w") * d), F.lit(0.0)).alias("s"))
    return total.crossJoin(F.broadcast(values.agg(F.countDistinct(node).alias("n")))).select((F.col("s") / (F.col("n") * len(columns))).alias("energy"))


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """node, component (its smallest node), by least neighbour labels and pointer jumping until nothing changes."""
    pairs = keep(both_ways(edges.select("src", "dst", F.lit(1.0).alias("w"))).select("src", "dst").distinct())
    labels = keep(nodes.select(F.col(node).alias("node")).where("node is not null").distinct().withColumn("component", F.col("node")))
    while True:
        heard = pairs.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("heard"))
        lower = labels.join(heard, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("heard", "component")).alias("component"))
        # Only labels that got a lower one themselves lead further; a giant component's label is spread over several keys.
        salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
        jump = lower.where("component <> node").select(F.col("node").alias("component"), F.col("component").alias("further"), salts)
        salted = lower.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        step = keep(salted.join(jump, ["component", "salt"], "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = step.where("component <> old").limit(1).count()
        forget(labels)
        labels = step.select("node", "component")
        if not changed:
            forget(pairs)
            return labels


def betti(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """n, e, beta0, beta1 of an undirected graph: components, and independent cycles max(0, e - n + beta0)."""
    labels = components(nodes, edges, node)
    counts = labels.agg(F.count("*").alias("n"), F.countDistinct("component").alias("beta0"))
    return counts.crossJoin(F.broadcast(edges.agg(F.count("*").alias("e")))).select("n", "e", "beta0", F.greatest(F.lit(0).cast("long"), F.col("e") - F.col("n") + F.col("beta0")).alias("beta1"))


def pairwise_connectivity(labels: DataFrame) -> DataFrame:
    """pairs: pairs of nodes that some path joins, the sum of s (s - 1) / 2 over components."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("s"))
    return sizes.agg(F.coalesce(F.sum((F.col("s") * (F.col("s") - 1) / 2).cast("long")), F.lit(0).cast("long")).alias("pairs"))


def without_top(nodes: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Graph without its k nodes of most edges, ties to the smaller node."""
    top = degrees(edges).orderBy(F.desc("degree"), "node").limit(k).select("node")
    left = nodes.join(F.broadcast(top), "node", "left_anti")
    return left, edges.join(F.broadcast(top.withColumnRenamed("node", "src")), "src", "left_anti").join(F.broadcast(top.withColumnRenamed("node", "dst")), "dst", "left_anti").select("src", "dst", "w")


def distances(edges: DataFrame, sources: DataFrame, length: str = "w", cutoff: float | None = None, nearest: int | None = None, slack: float = 0.0) -> DataFrame:
    """node, source, distance by relaxation from every source at once; a round looks only at what changed.

    With `nearest`, each node keeps only its so many nearest sources and those at most `slack` farther in every round:
    exact, as a source that is among a node's nearest is among those of every node on the way.
    """
    ways = keep(both_ways(edges.select("src", "dst", F.col(length).alias("w"))))
    best = keep(sources.select(F.col("node"), F.col("node").alias("source"), F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")))
    while True:
        step = best.where("fresh").join(ways, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "source", (F.col("distance") + F.col("w")).alias("distance"))
        if cutoff is not None:
            step = step.where(F.col("distance") <= cutoff)
        merged = best.select("node", "source", "distance", F.lit(True).alias("old")).unionByName(step.withColumn("old", F.lit(False)))
        now = merged.groupBy("node", "source").agg(F.min("distance").alias("distance"), F.min(F.when(F.col("old"), F.col("distance"))).alias("had")).select("node", "source", "distance", (F.col("had").isNull() | (F.col("distance") < F.col("had"))).alias("fresh"))
        if nearest is not None:
            ranked = now.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("distance", "source")))
            limit = F.max(F.when(F.col("r") <= nearest, F.col("distance"))).over(Window.partitionBy("node"))
            now = ranked.withColumn("limit", limit).where(F.col("distance") <= F.col("limit") + slack).drop("r", "limit")
        now = keep(now)
        forget(best)
        best = now
        if not best.where("fresh").limit(1).count():
            forget(ways)
            return best.select("node", "source", "distance")


def metropolis(edges: DataFrame) -> DataFrame:
    """i, j, p: gossip weights 1 / (1 + larger degree) along edges, the rest on the diagonal."""
    d = degrees(edges).select("node", "degree")
    ways = both_ways(edges).join(d.select(F.col("node").alias("src"), F.col("degree").alias("di")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dj")), "dst")
    off = ways.select(F.col("src").alias("i"), F.col("dst").alias("j"), (1.0 / (1 + F.greatest("di", "dj"))).alias("p"))
    return off.unionByName(off.groupBy("i").agg(F.sum("p").alias("s")).select("i", F.col("i").alias("j"), (1 - F.col("s")).alias("p")))


def mix(matrix: DataFrame, values: DataFrame) -> DataFrame:
    """node, v: matrix times vector."""
    return matrix.join(values.select(F.col("node").alias("j"), "v"), "j").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("p") * F.col("v")).alias("v"))


def chebyshev_mix(matrix: DataFrame, values: DataFrame, second: float, rounds: int) -> DataFrame:
    """Accelerated mixing by the Chebyshev recurrence for a matrix with that second eigenvalue (by size)."""
    if rounds <= 1 or second < 1e-9:
        return mix(matrix, values)
    before, now = values.select("node", F.lit(0.0).alias("v")), keep(values.select("node", (F.col("v") / 2).alias("v")))
    w_before, w_now = 0.0, 0.5
    for _ in range(rounds):
        w_next = 2 * w_now / second - w_before
        if abs(w_next) < 1e-12:
            break
        moved = mix(matrix, now).select("node", (F.col("v") * (2 / second)).alias("m"))
        step = keep(moved.join(before.withColumnRenamed("v", "b"), "node").select("node", (F.col("m") - F.lit(w_before / w_next) * F.col("b")).alias("v")))
        before, now, w_before, w_now = now, step, w_now, w_next
    return now.select("node", (F.col("v") * 2).alias("v"))


# The fluid's time step, stiffness, drag, viscosity, weights of loss, cost and information, and least density.
DT, STIFFNESS, DRAG, VISCOSITY, WEIGHTS, FLOOR = 0.01, 0.5, 0.8, 0.15, (1.0, 1.2, 0.9), 1e-12


def fluid(nodes: DataFrame, edges: DataFrame, steps: int, dt: float = DT, stiffness: float = STIFFNESS, drag: float = DRAG, viscosity: float = VISCOSITY, weights: tuple = WEIGHTS, floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """Densities node, rho and velocities src, dst, u of a fluid on a graph after some steps, all edges at once (Jacobi).

    nodes: node, rho, loss, cost, info; edges: src < dst, length. Velocity follows the
    gradients of pressure and potential, drag and smoothing; mass moves along edges and is
    floored and renormalised after each step. A node's edges are read by a join, never as a matrix.
    """
    phi = weights[0] * F.col("loss") + weights[1] * F.col("cost") - weights[2] * F.col("info")
    state = keep(nodes.select("node", F.col("rho").cast("double").alias("rho"), phi.alias("phi")))
    flow = keep(edges.select("src", "dst", F.col("length").cast("double").alias("length"), F.lit(0.0).alias("u")))
    deg = keep(flow.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("deg")))
    for _ in range(steps):
        pull = flow.select(F.explode(F.array(F.struct(F.col("src").alias("node"), (-F.col("u")).alias("x")), F.struct(F.col("dst").alias("node"), F.col("u").alias("x")))).alias("e")).groupBy(F.col("e.node").alias("node")).agg(F.sum("e.x").alias("x"))
        at = state.join(pull.join(deg, "node").select("node", (F.col("x") / F.col("deg")).alias("mean")), "node", "left").select("node", "rho", (stiffness * F.col("rho") + F.col("phi")).alias("head"), F.coalesce("mean", F.lit(0.0)).alias("mean"))
        a, b = (at.select(F.col("node").alias(s), F.col("rho").alias(f"rho_{s}"), F.col("head").alias(f"head_{s}"), F.col("mean").alias(f"mean_{s}")) for s in ("src", "dst"))
        smooth = F.col("mean_dst") - F.col("mean_src") - 2 * F.col("u")
        u = F.col("u") + dt * (-(F.col("head_dst") - F.col("head_src")) / F.col("length") - drag * F.col("u") + viscosity * smooth)
        moved = keep(flow.join(a, "src").join(b, "dst").select("src", "dst", "length", u.alias("u"), ((F.col("rho_src") + F.col("rho_dst")) / 2 * u).alias("flux")))
        gain = moved.select(F.explode(F.array(F.struct(F.col("src").alias("node"), (-F.col("flux")).alias("x")), F.struct(F.col("dst").alias("node"), F.col("flux").alias("x")))).alias("e")).groupBy(F.col("e.node").alias("node")).agg(F.sum("e.x").alias("gain"))
        raw = state.join(gain, "node", "left").select("node", F.greatest(F.col("rho") + dt * F.coalesce("gain", F.lit(0.0)), F.lit(floor)).alias("rho"), "phi")
        mass = raw.agg(F.sum("rho").alias("mass"))
        now = keep(raw.crossJoin(F.broadcast(mass)).select("node", (F.col("rho") / F.col("mass")).alias("rho"), "phi"))
        forget(state), forget(flow)
        state, flow = now, moved.select("src", "dst", "length", "u")
    return state.select("node", "rho"), flow.select("src", "dst", "u")


def fluid_components(nodes: DataFrame, edges: DataFrame, steps: int, dt: float = DT, stiffness: float = STIFFNESS, drag: float = DRAG, viscosity: float = VISCOSITY, floor: float = FLOOR) -> DataFrame:
    """node, part, rho after some steps of a fluid of several parts on a graph, with an unknown rest (part null) that doesn't move.

    nodes: node, part, rho, phi, one row for each node and part, and part null for the rest (phi unread);
    a node's rho sum to one. Each part flows like fluid(); then all are floored and scaled at each node
    so that they sum to one again. All parts go through the same joins, keyed by (node, part).
    """
    state = keep(nodes.where("part is not null").select("node", "part", F.col("rho").cast("double").alias("rho"), F.col("phi").cast("double").alias("phi")))
    rest = keep(nodes.where("part is null").select("node", F.col("rho").cast("double").alias("unknown")))
    plain = keep(edges.select("src", "dst", F.col("length").cast("double").alias("length")))
    deg = keep(plain.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("deg")))
    flow = keep(plain.join(state.select(F.col("node").alias("src"), "part"), "src").select("src", "dst", "part", "length", F.lit(0.0).alias("u")))
    ends = lambda v: F.explode(F.array(F.struct(F.col("src").alias("node"), (-F.col(v)).alias("x")), F.struct(F.col("dst").alias("node"), F.col(v).alias("x")))).alias("e")
    inflow = lambda rows, v: rows.select("part", ends(v)).groupBy(F.col("e.node").alias("node"), "part").agg(F.sum("e.x").alias("x"))
    for _ in range(steps):
        mean = inflow(flow, "u").join(deg, "node").select("node", "part", (F.col("x") / F.col("deg")).alias("mean"))
        at = state.join(mean, ["node", "part"], "left").select("node", "part", "rho", (stiffness * F.col("rho") + F.col("phi")).alias("head"), F.coalesce("mean", F.lit(0.0)).alias("mean"))
        a, b = (at.select(F.col("node").alias(s), "part", F.col("rho").alias(f"rho_{s}"), F.col("head").alias(f"head_{s}"), F.col("mean").alias(f"mean_{s}")) for s in ("src", "dst"))
        smooth = F.col("mean_dst") - F.col("mean_src") - 2 * F.col("u")
        u = F.col("u") + dt * (-(F.col("head_dst") - F.col("head_src")) / F.col("length") - drag * F.col("u") + viscosity * smooth)
        moved = keep(flow.join(a, ["src", "part"]).join(b, ["dst", "part"]).select("src", "dst", "part", "length", u.alias("u"), ((F.col("rho_src") + F.col("rho_dst")) / 2 * u).alias("flux")))
        raw = state.join(inflow(moved, "flux").withColumnRenamed("x", "gain"), ["node", "part"], "left").select("node", "part", "phi", F.greatest(F.col("rho") + dt * F.coalesce("gain", F.lit(0.0)), F.lit(floor)).alias("rho"))
        held = rest.select("node", F.greatest("unknown", F.lit(floor)).alias("unknown"))
        total = raw.groupBy("node").agg(F.sum("rho").alias("s")).join(held, "node").select("node", "unknown", (F.col("s") + F.col("unknown")).alias("s"))
        total = keep(total)
        now = keep(raw.join(total, "node").select("node", "part", (F.col("rho") / F.col("s")).alias("rho"), "phi"))
        left = keep(total.select("node", (F.col("unknown") / F.col("s")).alias("unknown")))
        for old in (state, flow, rest, total):
            forget(old)
        state, rest, flow = now, left, moved.select("src", "dst", "part", "length", "u")
    return state.select("node", "part", "rho").unionByName(rest.select("node", F.lit(None).cast(dict(state.dtypes)["part"]).alias("part"), F.col("unknown").alias("rho")))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """side ('shared', 'only_left', 'only_right'), n: how the edges of two graphs agree."""
    marked = left.select("src", "dst", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("src", "dst", F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = marked.groupBy("src", "dst").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    side: Column = F.when((F.col("l") == 1) & (F.col("r") == 1), "shared").when(F.col("l") == 1, "only_left").otherwise("only_right")
    return each.groupBy(side.alias("side")).agg(F.count("*").alias("n"))
