"""Dense linear algebra on blocks of bounded size, one block to a worker.

A block is one graph, kernel, mesh or training set. Its size is checked in the worker:
beyond MOST_NODES rows it raises, since eigenvalues of larger matrices would need another
method. Blocks are many and independent, so the work spreads by block.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NODES = 2_000


def per_block(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over each block's rows; the key column is added to its result."""
    kind = dict(df.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return df.where(F.col(key).isNotNull()).groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def _check(n: int) -> int:
    if n > MOST_NODES:
        raise ValueError(f"a block of {n} rows; at most {MOST_NODES} are solved densely")
    return n


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    n = _check(int(max(pdf.i.max(), pdf.j.max())) + 1)
    k = np.zeros((n, n))
    k[pdf.i.to_numpy(), pdf.j.to_numpy()] = pdf.k.to_numpy()
    return k


def _graph(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, ends of the edges as positions, and weights."""
    nodes, at = np.unique(np.concatenate([pdf.src.to_numpy(), pdf.dst.to_numpy()]), return_inverse=True)
    _check(len(nodes))
    return nodes, at[: len(pdf)], at[len(pdf) :], pdf.w.to_numpy().astype(float)


def laplacian_of(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    m = np.zeros((n, n))
    np.add.at(m, (a, b), -w), np.add.at(m, (b, a), -w)
    m[np.diag_indices(n)] = -m.sum(1)
    return m


def eigenvalues(edges: DataFrame, key: str) -> DataFrame:
    """key, mode, eigenvalue of each graph's combinatorial Laplacian, ascending, drift below zero clipped."""

    def run(pdf):
        nodes, a, b, w = _graph(pdf)
        values = np.maximum(np.linalg.eigvalsh(laplacian_of(len(nodes), a, b, w)), 0)
        return pd.DataFrame({"mode": np.arange(len(values)), "eigenvalue": values})

    return per_block(edges, key, run, "mode long, eigenvalue double")


def kernel_spectra(kernels: DataFrame) -> DataFrame:
    """kernel_id, psd, trace, entropy, dimension, gap of each kernel: positive semi-definite to 1e-8, von Neumann entropy, rows for 99 % of the trace, relative gap of the two largest eigenvalues."""

    def run(pdf):
        k = _matrix(pdf)
        values = np.linalg.eigvalsh((k + k.T) / 2)[::-1]
        good = bool(np.allclose(k, k.T, atol=1e-8) and values[-1] >= -1e-8)
        clipped = np.maximum(values, 0)
        total = clipped.sum()
        p = np.maximum(clipped / total, 1e-10) if total >= 1e-10 else np.ones(1)
        share = np.cumsum(clipped) / (total + 1e-12)
        gap = 0.0 if values[0] <= 0 else 1.0 if len(values) < 2 else (values[0] - values[1]) / values[0]
        return pd.DataFrame({"psd": [good], "trace": [float(np.trace(k))], "entropy": [float(-(p * np.log(p)).sum())], "dimension": [int(np.searchsorted(share, 0.99)) + 1], "gap": [float(gap)]})

    return per_block(kernels, "kernel_id", run, "psd boolean, trace double, entropy double, dimension long, gap double")


def project_psd(kernels: DataFrame, floor: float = 0.0) -> DataFrame:
    """kernel_id, i, j, k: each kernel made symmetric, with eigenvalues below the floor raised to it."""

    def run(pdf):
        k = _matrix(pdf)
        values, vectors = np.linalg.eigh((k + k.T) / 2)
        out = (vectors * np.maximum(values, floor)) @ vectors.T
        i, j = np.divmod(np.arange(out.size), len(out))
        return pd.DataFrame({"i": i, "j": j, "k": out.ravel()})

    return per_block(kernels, "kernel_id", run, "i long, j long, k double")


def log_det_change(kernels: DataFrame, first: str, second: str, floor: float = 1e-10) -> DataFrame:
    """nats: change of the log determinant of one kernel to another over the number of rows, never negative."""
    two = kernels.where(F.col("kernel_id").isin(first, second)).withColumn("block", F.lit(0))

    def run(pdf):
        det = {}
        for name in (first, second):
            k = _matrix(pdf[pdf.kernel_id == name])
            det[name] = np.log(np.maximum(np.linalg.eigvalsh(k), floor)).sum() / len(k)
        return pd.DataFrame({"nats": [max(0.0, float(det[second] - det[first]))]})

    return per_block(two, "block", run, "nats double").drop("block")


def spectral_state(edges: DataFrame, key: str, strength: float = 1.0, noise: float = 1.0, aware: bool = True) -> DataFrame:
    """key, mode, eigenvalue, h, curvature of each mode at the fixed point, from reference weights exp(-eigenvalue) (or one).

    h solves h = h0 exp(-1 - T(h)) for the separable source T(h) = strength w / (2 (noise + h)), with
    w the eigenvalue if aware; curvature is the diagonal of the Hessian, -1/h - T'(h).
    """

    def run(pdf):
        nodes, a, b, w = _graph(pdf)
        values = np.maximum(np.linalg.eigvalsh(laplacian_of(len(nodes), a, b, w)), 0)
        weight = values if aware else np.ones(len(values))
        h = np.full(len(values), math.exp(-1))
        for _ in range(500):
            new = np.exp(-1 - strength * weight / (2 * (noise + h)))
            if np.abs(new - h).max() < 1e-13:
                break
            h = new
        slope = -strength * weight / (2 * (noise + h) ** 2)
        return pd.DataFrame({"mode": np.arange(len(values)), "eigenvalue": values, "h": h, "curvature": -1 / h - slope})

    return per_block(edges, key, run, "mode long, eigenvalue double, h double, curvature double")


def spectral_kernel(edges: DataFrame, key: str, time: float) -> DataFrame:
    """key, i, j, k: heat kernel of each graph at a time; rows by the sorted nodes."""

    def run(pdf):
        nodes, a, b, w = _graph(pdf)
        values, vectors = np.linalg.eigh(laplacian_of(len(nodes), a, b, w))
        out = (vectors * np.exp(-time * np.maximum(values, 0))) @ vectors.T
        i, j = np.divmod(np.arange(out.size), len(out))
        return pd.DataFrame({"i": i, "j": j, "k": out.ravel()})

    return per_block(edges, key, run, "i long, j long, k double")


def smooth_labels(edges: DataFrame, labels: DataFrame, key: str, strength: float, heat: bool = False) -> DataFrame:
    """key, node, cat, p: label shares smoothed over each graph, by (I + strength L) x = p or by heat exp(-strength L) p, then renormalised.

    labels: key, node, cat, p. Nodes without edges or labels are left out.
    """
    joined = edges.select(key, F.lit("edge").alias("what"), "src", "dst", "w", F.lit(None).cast("string").alias("cat")).unionByName(labels.select(key, F.lit("label").alias("what"), F.col("node").alias("src"), F.col("node").alias("dst"), F.col("p").alias("w"), "cat"))
    kind = dict(edges.dtypes)["src"]

    def run(pdf):
        nodes, a, b, w = _graph(pdf[pdf.what == "edge"])
        lap = laplacian_of(len(nodes), a, b, w)
        said = pdf[(pdf.what == "label") & pdf.src.isin(nodes)]
        cats, col = np.unique(said.cat.to_numpy().astype(str), return_inverse=True)
        p = np.zeros((len(nodes), len(cats)))
        p[np.searchsorted(nodes, said.src.to_numpy()), col] = said.w.to_numpy()
        if heat:
            values, vectors = np.linalg.eigh(lap)
            x = (vectors * np.exp(-strength * np.maximum(values, 0))) @ (vectors.T @ p)
        else:
            x = np.linalg.solve(np.eye(len(nodes)) + strength * lap, p)
        x = np.maximum(x, 0)
        x /= np.where(x.sum(1, keepdims=True) > 0, x.sum(1, keepdims=True), 1)
        i, j = np.divmod(np.arange(x.size), max(1, x.shape[1]))
        return pd.DataFrame({"node": nodes[i], "cat": cats[j] if len(cats) else [], "p": x.ravel()})

    return per_block(joined, key, run, f"node {kind}, cat string, p double")


def persistence_0d(edges: DataFrame, key: str) -> DataFrame:
    """key, birth, death: components of each graph as edges come in by length; deaths are the lengths of a minimum spanning forest, null for what never dies."""

    def run(pdf):
        nodes, a, b, w = _graph(pdf)
        parent = list(range(len(nodes)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        deaths = []
        for e in np.argsort(w, kind="stable"):
            x, y = find(a[e]), find(b[e])
            if x != y:
                parent[max(x, y)] = min(x, y)
                deaths.append(float(w[e]))
        deaths += [None] * (len(nodes) - len(deaths))
        return pd.DataFrame({"birth": np.zeros(len(deaths)), "death": pd.array(deaths, dtype="Float64")})

    return per_block(edges, key, run, "birth double, death double")


def mesh_topology(faces: DataFrame, key: str) -> DataFrame:
    """key, vertices, edges, faces, beta0, beta1, beta2 of each triangle mesh (a, b, c), by ranks of the boundary maps."""

    def run(pdf):
        tri = np.sort(pdf[["a", "b", "c"]].to_numpy(), 1)
        tri = np.unique(tri, axis=0)
        edges = np.unique(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [0, 2]]]), axis=0)
        nodes = np.unique(edges)
        _check(max(len(nodes), len(edges), len(tri)))
        at = {tuple(e): i for i, e in enumerate(edges.tolist())}
        d1, d2 = np.zeros((len(nodes), len(edges))), np.zeros((len(edges), len(tri)))
        for i, (u, v) in enumerate(edges):
            d1[np.searchsorted(nodes, u), i], d1[np.searchsorted(nodes, v), i] = -1, 1
        for i, (u, v, w) in enumerate(tri.tolist()):
            d2[at[u, v], i], d2[at[v, w], i], d2[at[u, w], i] = 1, 1, -1
        r1, r2 = np.linalg.matrix_rank(d1), np.linalg.matrix_rank(d2)
        return pd.DataFrame({"vertices": [len(nodes)], "edges": [len(edges)], "faces": [len(tri)], "beta0": [len(nodes) - r1], "beta1": [len(edges) - r1 - r2], "beta2": [len(tri) - r2]})

    return per_block(faces, key, run, "vertices long, edges long, faces long, beta0 long, beta1 long, beta2 long")


def edge_decomposition(flows: DataFrame, key: str) -> DataFrame:
    """key, src, dst, gradient, harmonic: each graph's edge signal w (positive from src to dst) split into a potential's differences and the cycles' rest."""
    kind = dict(flows.dtypes)["src"]

    def run(pdf):
        nodes, a, b, f = _graph(pdf)
        d = np.zeros((len(f), len(nodes)))
        d[np.arange(len(f)), a], d[np.arange(len(f)), b] = -1, 1
        gradient = d @ np.linalg.lstsq(d, f, rcond=None)[0]
        return pd.DataFrame({"src": pdf.src.to_numpy(), "dst": pdf.dst.to_numpy(), "gradient": gradient, "harmonic": f - gradient})

    return per_block(flows, key, run, f"src {kind}, dst {kind}, gradient double, harmonic double")


def gp_posterior(rows: DataFrame, key: str, lengths: tuple[float, float] = (1.0, 1.0), signal: float = 1.0, noise: float = 0.1) -> DataFrame:
    """key, id, mean, std, evidence: Gaussian process over (x, y) of each block, trained on rows with a value z, read at rows without.

    evidence is the log marginal likelihood of the training rows.
    """
    kind = dict(rows.dtypes)["id"]

    def run(pdf):
        train, test = pdf[pdf.z.notna()], pdf[pdf.z.isna()]
        _check(len(train))
        p, q = train[["x", "y"]].to_numpy(float), test[["x", "y"]].to_numpy(float)
        cov = lambda s, t: signal**2 * np.exp(-0.5 * ((s[:, None, 0] - t[None, :, 0]) ** 2 / lengths[0] ** 2 + (s[:, None, 1] - t[None, :, 1]) ** 2 / lengths[1] ** 2))
        if not len(train):
            return pd.DataFrame({"id": test.id, "mean": 0.0, "std": signal, "evidence": 0.0})
        root = np.linalg.cholesky(cov(p, p) + (noise**2 + 1e-8) * np.eye(len(p)))
        white = np.linalg.solve(root, train.z.to_numpy(float))
        across = np.linalg.solve(root, cov(p, q))
        evidence = -0.5 * white @ white - np.log(np.diag(root)).sum() - 0.5 * len(p) * math.log(2 * math.pi)
        return pd.DataFrame({"id": test.id.to_numpy(), "mean": across.T @ white, "std": np.sqrt(np.maximum(signal**2 - (across**2).sum(0), 1e-12)), "evidence": float(evidence)})

    return per_block(rows, key, run, f"id {kind}, mean double, std double, evidence double")


def solve_riccati(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Stabilising solution of a'p + pa - p b r^-1 b' p + q = 0 from the stable eigenvectors of the Hamiltonian."""
    n = len(a)
    ham = np.block([[a, -b @ np.linalg.inv(r) @ b.T], [-q, -a.T]])
    values, vectors = np.linalg.eig(ham)
    stable = vectors[:, np.argsort(values.real)[:n]]
    p = np.real(stable[n:] @ np.linalg.inv(stable[:n]))
    return (p + p.T) / 2


def riccati(systems: DataFrame, key: str, n: int) -> DataFrame:
    """key, p, residual: gain of each system with row-major arrays a, b, q, r (b of n columns)."""

    def run(pdf):
        row = pdf.iloc[0]
        a, b, q, r = (np.reshape(np.array(row[c], float), (n, n)) for c in "abqr")
        p = solve_riccati(a, b, q, r)
        rest = a.T @ p + p @ a - p @ b @ np.linalg.inv(r) @ b.T @ p + q
        return pd.DataFrame({"p": [p.ravel().tolist()], "residual": [float(np.linalg.norm(rest))]})

    return per_block(systems, key, run, "p array<double>, residual double")


def betweenness(edges: DataFrame, key: str) -> DataFrame:
    """key, node, betweenness: shortest paths (by number of edges) through each node, each pair once."""
    kind = dict(edges.dtypes)["src"]

    def run(pdf):
        nodes, a, b, _ = _graph(pdf)
        near: list[list[int]] = [[] for _ in nodes]
        for x, y in {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}:
            near[x].append(y), near[y].append(x)
        score = np.zeros(len(nodes))
        for s in range(len(nodes)):
            depth, paths, order, before = {s: 0}, np.zeros(len(nodes)), [], [[] for _ in nodes]
            paths[s] = 1
            queue = deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                for u in near[v]:
                    if u not in depth:
                        depth[u] = depth[v] + 1
                        queue.append(u)
                    if depth[u] == depth[v] + 1:
                        paths[u] += paths[v]
                        before[u].append(v)
            share = np.zeros(len(nodes))
            for v in reversed(order):
                for u in before[v]:
                    share[u] += paths[u] / paths[v] * (1 + share[v])
                if v != s:
                    score[v] += share[v]
        return pd.DataFrame({"node": nodes, "betweenness": score / 2})

    return per_block(edges, key, run, f"node {kind}, betweenness double")


def fragmentation(edges: DataFrame, key: str, most: int) -> DataFrame:
    """key, removed, node, pairs: nodes removed one by one, each time the one whose loss leaves the fewest joined pairs; the first of equals."""
    kind = dict(edges.dtypes)["src"]

    def joined(near, gone):
        seen, total = set(gone), 0
        for s in near:
            if s in seen:
                continue
            size, stack = 0, [s]
            seen.add(s)
            while stack:
                v = stack.pop()
                size += 1
                for u in near[v]:
                    if u not in seen:
                        seen.add(u)
                        stack.append(u)
            total += size * (size - 1) // 2
        return total

    def run(pdf):
        nodes, a, b, _ = _graph(pdf)
        near = {i: set() for i in range(len(nodes))}
        for x, y in zip(a.tolist(), b.tolist()):
            near[x].add(y), near[y].add(x)
        gone: list[int] = []
        rows = [(0, None, joined(near, gone))]
        for k in range(min(most, len(nodes))):
            left, best = min((joined(near, [*gone, v]), v) for v in near if v not in gone)
            gone.append(best)
            rows.append((k + 1, nodes[best], left))
        out = pd.DataFrame(rows, columns=["removed", "node", "pairs"])
        out["node"] = out["node"].astype("Int64" if kind in ("bigint", "int") else object)
        return out

    return per_block(edges, key, run, f"removed int, node {kind}, pairs long")


def max_flow(edges: DataFrame, key: str, sources: list, sinks: list) -> DataFrame:
    """key, flow: largest flow of each graph from all sources to all sinks, w the capacity both ways, by shortest augmenting paths."""

    def run(pdf):
        nodes, a, b, w = _graph(pdf)
        n = len(nodes)
        at = {v: i for i, v in enumerate(nodes.tolist())}
        room: list[dict[int, float]] = [{} for _ in range(n + 2)]
        for x, y, c in zip(a.tolist(), b.tolist(), w.tolist()):
            room[x][y] = room[x].get(y, 0) + c
            room[y][x] = room[y].get(x, 0) + c
        for s in sources:
            if s in at:
                room[n][at[s]], room[at[s]][n] = math.inf, 0.0
        for t in sinks:
            if t in at:
                room[at[t]][n + 1], room[n + 1][at[t]] = math.inf, 0.0
        flow = 0.0
        while True:
            came, queue = {n: n}, deque([n])
            while queue and n + 1 not in came:
                v = queue.popleft()
                for u, c in room[v].items():
                    if c > 1e-12 and u not in came:
                        came[u] = v
                        queue.append(u)
            if n + 1 not in came:
                return pd.DataFrame({"flow": [flow]})
            path, v = [], n + 1
            while v != n:
                path.append((came[v], v))
                v = came[v]
            least = min(room[x][y] for x, y in path)
            if math.isinf(least):
                return pd.DataFrame({"flow": [math.inf]})
            for x, y in path:
                room[x][y] -= least
                room[y][x] = room[y].get(x, 0.0) + least
            flow += least

    return per_block(edges, key, run, "flow double")


def cheapest_paths(edges: DataFrame, key: str, source) -> DataFrame:
    """key, node, distance from one node within each graph."""
    kind = dict(edges.dtypes)["src"]

    def run(pdf):
        nodes, a, b, w = _graph(pdf)
        near: list[list[tuple[int, float]]] = [[] for _ in nodes]
        for x, y, c in zip(a.tolist(), b.tolist(), w.tolist()):
            near[x].append((y, c)), near[y].append((x, c))
        start = int(np.searchsorted(nodes, source))
        best, heap = {}, [(0.0, start)] if start < len(nodes) and nodes[start] == source else []
        while heap:
            d, v = heapq.heappop(heap)
            if v in best:
                continue
            best[v] = d
            for u, c in near[v]:
                if u not in best:
                    heapq.heappush(heap, (d + c, u))
        return pd.DataFrame({"node": nodes[list(best)] if best else [], "distance": list(best.values())})

    return per_block(edges, key, run, f"node {kind}, distance double")


def attention_state(weights: DataFrame, key: str) -> DataFrame:
    """key, entropy, fiedler, h_mean of each attention matrix i, j, k: made symmetric, without diagonal, read as a graph."""

    def run(pdf):
        k = _matrix(pdf)
        k = (k + k.T) / 2
        k = k - min(0.0, float(k.min()))
        np.fill_diagonal(k, 0)
        values = np.maximum(np.linalg.eigvalsh(np.diag(k.sum(1)) - k), 0)
        h = np.exp(-1 - values / (1 + math.exp(-1)))
        p = h / h.sum()
        return pd.DataFrame({"entropy": [float(-(p * np.log(p)).sum())], "fiedler": [float(values[1]) if len(values) > 1 else 0.0], "h_mean": [float(h.mean())]})

    return per_block(weights, key, run, "entropy double, fiedler double, h_mean double")


def alignment(kernels: DataFrame) -> DataFrame:
    """a, b, cka of each pair of kernels of one size: linear alignment after double centring, by window means and sums."""
    from pyspark.sql import Window

    from weft.operators.kernels import few_kernels

    few_kernels(kernels)
    rows, cols, all_ = Window.partitionBy("kernel_id", "i"), Window.partitionBy("kernel_id", "j"), Window.partitionBy("kernel_id")
    centred = kernels.withColumn("c", F.col("k") - F.avg("k").over(rows) - F.avg("k").over(cols) + F.avg("k").over(all_))
    own = centred.groupBy("kernel_id").agg(F.sum(F.col("c") * F.col("c")).alias("s"))
    a, b = (centred.select(F.col("kernel_id").alias(s), "i", "j", F.col("c").alias(f"c{s}")) for s in "ab")
    dots = a.join(b, ["i", "j"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("ca") * F.col("cb")).alias("d"))
    sa, sb = (own.select(F.col("kernel_id").alias(s), F.col("s").alias(f"s{s}")) for s in "ab")
    return dots.join(sa, "a").join(sb, "b").select("a", "b", (F.col("d") / (F.sqrt(F.col("sa") * F.col("sb")) + 1e-12)).alias("cka"))


def factorisation(joint: DataFrame, first: DataFrame, second: DataFrame, m: int) -> DataFrame:
    """relative: how far a joint kernel over pairs (row = i1 * m + i2) is from the product of two kernels, relative to its own norm."""
    split = joint.select((F.floor(F.col("i") / m)).alias("i1"), (F.col("i") % m).alias("i2"), (F.floor(F.col("j") / m)).alias("j1"), (F.col("j") % m).alias("j2"), "k")
    a = first.select(F.col("i").alias("i1"), F.col("j").alias("j1"), F.col("k").alias("ka"))
    b = second.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("k").alias("kb"))
    rest = F.col("k") - F.col("ka") * F.col("kb")
    return split.join(a, ["i1", "j1"]).join(b, ["i2", "j2"]).agg((F.sqrt(F.sum(rest * rest)) / (F.sqrt(F.sum(F.col("k") * F.col("k"))) + 1e-12)).alias("relative"))


def compress_points(points: DataFrame, edges: DataFrame, key: str, modes: int) -> DataFrame:
    """key, modes, distortion: each mesh's vertices rebuilt from its lowest Laplacian modes, error relative to their spread.

    points: key, id, x, y, z; edges: key, src, dst, w.
    """
    both = points.select(key, F.lit("p").alias("what"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"), "x", "y", "z").unionByName(edges.select(key, F.lit("e").alias("what"), "src", "dst", "w", *(F.lit(None).cast("double").alias(c) for c in "xyz")))

    def run(pdf):
        at = pdf[pdf.what == "p"].sort_values("src")
        ids = at.src.to_numpy()
        _check(len(ids))
        e = pdf[pdf.what == "e"]
        lap = laplacian_of(len(ids), np.searchsorted(ids, e.src.to_numpy()), np.searchsorted(ids, e.dst.to_numpy()), e.w.to_numpy())
        v = at[["x", "y", "z"]].to_numpy()
        low = np.linalg.eigh(lap)[1][:, :modes]
        error = v - low @ (low.T @ v)
        spread = np.linalg.norm(v - v.mean(0))
        return pd.DataFrame({"modes": [min(modes, len(ids))], "distortion": [float(np.linalg.norm(error) / spread) if spread else 0.0]})

    return per_block(both, key, run, "modes long, distortion double")


def fit_solids(points: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """key, a, b, c, e1, e2, loss: superquadric of each centred, axis-parallel point set, by damped least squares on the radial inside-outside value."""

    def run(pdf):
        p = np.abs(pdf[["x", "y", "z"]].to_numpy(float) - pdf[["x", "y", "z"]].mean().to_numpy(float)) + 1e-9

        def residual(t):
            s, e = np.exp(t[:3]), 0.1 + 1.9 / (1 + np.exp(-t[3:]))
            f = ((p[:, 0] / s[0]) ** (2 / e[1]) + (p[:, 1] / s[1]) ** (2 / e[1])) ** (e[1] / e[0]) + (p[:, 2] / s[2]) ** (2 / e[0])
            return np.sqrt(np.prod(s)) * (f ** (e[0] / 2) - 1)

        t, damp = np.concatenate([np.log(p.max(0)), [0.0, 0.0]]), 1e-2
        r = residual(t)
        for _ in range(rounds):
            jac = np.stack([(residual(t + 1e-5 * np.eye(5)[k]) - r) / 1e-5 for k in range(5)], 1)
            step = np.linalg.solve(jac.T @ jac + damp * np.eye(5), -jac.T @ r)
            new = residual(t + step)
            if new @ new < r @ r:
                t, r, damp = t + step, new, damp / 3
            else:
                damp *= 4
        e = 0.1 + 1.9 / (1 + np.exp(-t[3:]))
        s = np.exp(t[:3])
        return pd.DataFrame({"a": [s[0]], "b": [s[1]], "c": [s[2]], "e1": [e[0]], "e2": [e[1]], "loss": [float(r @ r / len(r))]})

    return per_block(points, key, run, "a double, b double, c double, e1 double, e2 double, loss double")


def cosine_code(rows: DataFrame, id_col: str, values: str, keep: int) -> DataFrame:
    """id, code, rebuilt: the first cosine coefficients of each array, and the array they give back."""

    @F.pandas_udf("struct<code:array<double>,rebuilt:array<double>>")
    def code(v: pd.Series) -> pd.DataFrame:
        codes, back = [], []
        for x in v:
            if x is None or not len(x):
                codes.append([]), back.append([])
                continue
            n = len(x)
            basis = np.cos(np.pi * (np.arange(n)[None, :] + 0.5) * np.arange(min(keep, n))[:, None] / n)
            c = basis @ np.asarray(x, float)
            scale = np.where(np.arange(len(c)) == 0, 1 / n, 2 / n)
            codes.append(c.tolist()), back.append((scale * c @ basis).tolist())
        return pd.DataFrame({"code": codes, "rebuilt": back})

    return rows.select(id_col, code(values).alias("c")).select(id_col, "c.code", "c.rebuilt")


def persistence_1d(faces: DataFrame, key: str) -> DataFrame:
    """key, birth, death: loops of each triangle mesh as edges and then faces come in by length; faces (a, b, c) with lengths ab, bc, ca.

    Pairs of positive length only, by reduction of the boundary matrix; loops that no face fills have a null death.
    """

    def run(pdf):
        length: dict[tuple[int, int], float] = {}
        for r in pdf.itertuples(index=False):
            for p, q, w in ((r.a, r.b, r.ab), (r.b, r.c, r.bc), (r.c, r.a, r.ca)):
                length[min(p, q), max(p, q)] = float(w)
        edges = sorted(length, key=lambda e: (length[e], e))
        _check(len(edges))
        at = {e: i for i, e in enumerate(edges)}
        parent = {v: v for e in edges for v in e}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        loops = set()
        for i, (p, q) in enumerate(edges):
            x, y = find(p), find(q)
            if x == y:
                loops.add(i)
            else:
                parent[x] = y
        triangles = sorted({tuple(sorted(t)) for t in pdf[["a", "b", "c"]].itertuples(index=False)}, key=lambda t: (max(length[t[0], t[1]], length[t[1], t[2]], length[t[0], t[2]]), t))
        low: dict[int, set] = {}
        pairs = []
        for t in triangles:
            column = {at[t[0], t[1]], at[t[1], t[2]], at[t[0], t[2]]}
            while column and max(column) in low:
                column ^= low[max(column)]
            if column:
                born = max(column)
                low[born] = column
                loops.discard(born)
                death = max(length[t[0], t[1]], length[t[1], t[2]], length[t[0], t[2]])
                if death > length[edges[born]]:
                    pairs.append((length[edges[born]], death))
        pairs += [(length[edges[i]], None) for i in sorted(loops)]
        return pd.DataFrame({"birth": [p[0] for p in pairs], "death": pd.array([p[1] for p in pairs], dtype="Float64")})

    return per_block(faces, key, run, "birth double, death double")


def adapt_lengths(rows: DataFrame, key: str, steps: int = 20, rate: float = 0.05, penalty: float = 0.0) -> DataFrame:
    """key, length_x, length_y, signal, noise, evidence: kernel parameters of each block's training rows (x, y, z) after some clipped ascent steps on the penalised log marginal likelihood."""

    def run(pdf):
        train = pdf[pdf.z.notna()]
        p, z = train[["x", "y"]].to_numpy(float), train.z.to_numpy(float)
        _check(len(p))
        dx, dy = ((p[:, None, k] - p[None, :, k]) ** 2 for k in (0, 1))

        def evidence(t):
            lx, ly, s, n = np.exp(t)
            cov = s**2 * np.exp(-0.5 * (dx / lx**2 + dy / ly**2)) + (n**2 + 1e-8) * np.eye(len(p))
            root = np.linalg.cholesky(cov)
            white = np.linalg.solve(root, z)
            return -0.5 * white @ white - np.log(np.diag(root)).sum() - 0.5 * len(p) * math.log(2 * math.pi)

        t = np.array([0.0, 0.0, 0.0, -1.0])
        for _ in range(steps if len(p) > 1 else 0):
            slope = np.array([(evidence(t + 1e-4 * e) - evidence(t - 1e-4 * e)) / 2e-4 for e in np.eye(4)]) - penalty * t
            size = np.linalg.norm(slope)
            t = np.clip(t + rate * slope * min(1.0, 3.0 / size if size else 1.0), -4, 2)
        return pd.DataFrame([[*np.exp(t), float(evidence(t)) if len(p) else 0.0]], columns=["length_x", "length_y", "signal", "noise", "evidence"])

    return per_block(rows, key, run, "length_x double, length_y double, signal double, noise double, evidence double")


def weakening_sweep(edges: DataFrame, key: str, weak: str, factors: list[float]) -> DataFrame:
    """key, factor, fiedler, entropy, gap of each graph as its weak edges (a boolean column) are scaled by each factor: one block for each graph and factor."""
    scaled = edges.withColumn("factor", F.explode(F.array(*map(F.lit, factors)))).withColumn("w", F.when(F.col(weak), F.col("w") * F.col("factor")).otherwise(F.col("w"))).withColumn("block", F.concat_ws("\x1f", F.col(key).cast("string"), F.col("factor").cast("string")))
    state = spectral_state(scaled.select("block", "src", "dst", "w"), "block")
    names = scaled.select("block", key, "factor").distinct()
    summary = state.groupBy("block").agg(F.max(F.when(F.col("mode") == 1, F.col("eigenvalue"))).alias("fiedler"), (F.ln(F.sum("h")) - F.sum(F.col("h") * F.ln("h")) / F.sum("h")).alias("entropy"), F.min(F.when(F.col("eigenvalue") > 1e-8, -F.col("curvature"))).alias("gap"))
    return names.join(summary, "block").drop("block")


def _boundaries(tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, edges (smaller node first) and the boundary maps of edges and faces of a triangle mesh."""
    tri = np.unique(np.sort(tri, 1), axis=0)
    edges = np.unique(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [0, 2]]]), axis=0)
    nodes = np.unique(edges)
    _check(max(len(nodes), len(edges), len(tri)))
    at = {tuple(e): i for i, e in enumerate(edges.tolist())}
    d1, d2 = np.zeros((len(nodes), len(edges))), np.zeros((len(edges), len(tri)))
    for i, (u, v) in enumerate(edges):
        d1[np.searchsorted(nodes, u), i], d1[np.searchsorted(nodes, v), i] = -1, 1
    for i, (u, v, w) in enumerate(tri.tolist()):
        d2[at[u, v], i], d2[at[v, w], i], d2[at[u, w], i] = 1, 1, -1
    return nodes, edges, d1, d2


def mesh_laplacians(faces: DataFrame, key: str) -> DataFrame:
    """key, rank (0 nodes, 1 edges, 2 faces), mode, eigenvalue of each triangle mesh's Laplacians; the number of zeros is the Betti number of that rank."""

    def run(pdf):
        _, _, d1, d2 = _boundaries(pdf[["a", "b", "c"]].to_numpy())
        out = []
        for rank, lap in enumerate((d1 @ d1.T, d1.T @ d1 + d2 @ d2.T, d2.T @ d2)):
            values = np.maximum(np.linalg.eigvalsh(lap), 0)
            out.append(pd.DataFrame({"rank": rank, "mode": np.arange(len(values)), "eigenvalue": values}))
        return pd.concat(out)

    return per_block(faces, key, run, "rank int, mode long, eigenvalue double")


def mesh_flow_parts(flows: DataFrame, faces: DataFrame, key: str) -> DataFrame:
    """key, src, dst, gradient, curl, harmonic of each mesh's edge signal w (src < dst, positive from src to dst): a potential's differences, circulation round faces, and circulation round holes. Edges of the mesh without a signal carry 0."""
    both = flows.select(key, "src", "dst", "w", F.lit(None).cast("long").alias("c")).unionByName(faces.select(key, F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0.0).alias("w"), F.col("c").cast("long").alias("c")))

    def run(pdf):
        nodes, edges, d1, d2 = _boundaries(pdf[pdf.c.notna()][["src", "dst", "c"]].to_numpy().astype("int64"))
        at = {tuple(e): i for i, e in enumerate(edges.tolist())}
        f = np.zeros(len(edges))
        for r in pdf[pdf.c.isna()].itertuples(index=False):
            if (r.src, r.dst) in at:
                f[at[r.src, r.dst]] = r.w
        gradient = d1.T @ np.linalg.lstsq(d1.T, f, rcond=None)[0]
        curl = d2 @ np.linalg.lstsq(d2, f - gradient, rcond=None)[0]
        return pd.DataFrame({"src": edges[:, 0], "dst": edges[:, 1], "gradient": gradient, "curl": curl, "harmonic": f - gradient - curl})

    return per_block(both, key, run, "src long, dst long, gradient double, curl double, harmonic double")


def residual_share(parts: DataFrame, key: str) -> DataFrame:
    """key, residual: share of a flow's energy that no potential explains, of edge_decomposition(); 0 for no flow."""
    f = F.col("gradient") + F.col("harmonic")
    return parts.groupBy(key).agg(F.when(F.sum(f * f) > 1e-12, F.sum(F.col("harmonic") * F.col("harmonic")) / F.sum(f * f)).otherwise(0.0).alias("residual"))


def coupling_entropy(jacobians: DataFrame, key: str = "kernel_id") -> DataFrame:
    """key, n, entropy: mean over rows of the entropy of a row's shares off the diagonal (i, j, k by size); a row without any couples evenly."""
    cells = jacobians.where("i <> j").groupBy(key, "i").agg(F.sum(F.abs("k")).alias("s"), F.sum(F.when(F.col("k") != 0, F.abs("k") * F.ln(F.abs("k"))).otherwise(0.0)).alias("e"))
    n = jacobians.groupBy(key).agg((F.max("i") + 1).alias("n"))
    rows = jacobians.select(key, "i").distinct().join(n, key).join(cells, [key, "i"], "left")
    each = F.when(F.coalesce("s", F.lit(0.0)) < 1e-15, F.ln(F.greatest(F.col("n") - 1, F.lit(1)).cast("double"))).otherwise(F.ln("s") - F.col("e") / F.col("s"))
    return rows.groupBy(key).agg(F.max("n").alias("n"), F.avg(F.when(F.col("n") < 2, 0.0).otherwise(each)).alias("entropy"))


def fit_riccati(systems: DataFrame, key: str, n: int, rounds: int = 50) -> DataFrame:
    """key, p, residual, rounds: gain of each system by Newton's steps on the residual, each a linear equation solved by its Kronecker form; for systems whose closed form fails. Starts from a stabilising multiple of one."""

    def run(pdf):
        row = pdf.iloc[0]
        a, b, q, r = (np.reshape(np.array(row[c], float), (n, n)) for c in "abqr")
        s, eye = b @ np.linalg.inv(r) @ b.T, np.eye(n)
        p = (np.linalg.norm(a, 2) + 1) * 2 * np.linalg.pinv(s)
        p = (p + p.T) / 2
        rest, k = np.inf, 0
        for k in range(1, rounds + 1):
            closed = a - s @ p
            p = np.linalg.solve(np.kron(closed.T, eye) + np.kron(eye, closed.T), -(q + p @ s @ p).ravel()).reshape(n, n)
            p = (p + p.T) / 2
            rest = float(np.linalg.norm(a.T @ p + p @ a - p @ s @ p + q))
            if rest < 1e-11 * max(1.0, float(np.linalg.norm(q))):
                break
        return pd.DataFrame({"p": [p.ravel().tolist()], "residual": [rest], "rounds": [k]})

    return per_block(systems, key, run, "p array<double>, residual double, rounds int")


def fit_posed_solids(points: DataFrame, key: str) -> DataFrame:
    """key, centre, rotation (nine numbers, row by row), a, b, c, e1, e2, loss: superquadric of each point set in its own principal axes, the longest first; see fit_solids."""

    def pose(pdf):
        p = pdf[["x", "y", "z"]].to_numpy(float)
        centre = p.mean(0)
        _, axes = np.linalg.eigh(np.cov((p - centre).T) + 1e-12 * np.eye(3))
        axes = axes[:, ::-1] * np.where(axes[:, ::-1][np.abs(axes[:, ::-1]).argmax(0), range(3)] < 0, -1, 1)
        if np.linalg.det(axes) < 0:
            axes[:, 2] *= -1
        local = (p - centre) @ axes
        return pd.DataFrame({"x": local[:, 0], "y": local[:, 1], "z": local[:, 2], "centre": [centre.tolist()] * len(p), "rotation": [axes.ravel().tolist()] * len(p)})

    from weft.sources.tables import keep

    posed = keep(per_block(points, key, pose, "x double, y double, z double, centre array<double>, rotation array<double>"))
    frames = posed.groupBy(key).agg(F.first("centre").alias("centre"), F.first("rotation").alias("rotation"))
    return frames.join(fit_solids(posed.select(key, "x", "y", "z"), key), key)


def fit_trees(points: DataFrame, key: str, radius: float = 0.4, cell: float = 0.1) -> DataFrame:
    """key, trunk_x, trunk_y, trunk_base, trunk_height, trunk_radius, trunk_points, crown_x, crown_y, crown_z, crown_a, crown_b, crown_c: a tree as an upright trunk and an ellipsoid crown.

    The trunk stands where upright columns of cells are filled over the greatest height; its points are those
    within the largest radius of that axis below the crown, which begins where points leave that radius. The
    crown's half axes are those of an ellipsoid with the second moments of the other points. No random choice.
    """

    def run(pdf):
        p = pdf[["x", "y", "z"]].to_numpy(float)
        at = np.floor(p / cell).astype(int)
        filled = np.unique(at, axis=0)
        columns, heights = np.unique(filled[:, :2], axis=0, return_counts=True)
        best = columns[heights == heights.max()]
        axis = (best[np.lexsort((best[:, 1], best[:, 0]))[0]] + 0.5) * cell
        for _ in range(5):  # the axis moves to the middle of what stands around it
            near = np.hypot(*(p[:, :2] - axis).T) <= radius
            axis = np.median(p[near, :2], axis=0) if near.any() else axis
        off = np.hypot(*(p[:, :2] - axis).T)
        wide = p[off > radius, 2]
        top = np.quantile(wide, 0.02) if len(wide) else p[:, 2].max() + 1
        trunk = (off <= radius) & (p[:, 2] < top)
        stem, crown = (p[trunk] if trunk.sum() >= 3 else p), (p[~trunk] if (~trunk).sum() >= 3 else p)
        low, high = np.quantile(stem[:, 2], [0.05, 0.95])
        middle = crown.mean(0)
        axes = np.sqrt(5 * np.maximum(crown.var(0), 1e-12))
        return pd.DataFrame([[*axis, low, high - low, float(np.quantile(np.hypot(*(stem[:, :2] - axis).T), 0.9)), int(trunk.sum()), *middle, *axes]], columns=["trunk_x", "trunk_y", "trunk_base", "trunk_height", "trunk_radius", "trunk_points", "crown_x", "crown_y", "crown_z", "crown_a", "crown_b", "crown_c"])

    doubles = ", ".join(f"{c} double" for c in ("trunk_x", "trunk_y", "trunk_base", "trunk_height", "trunk_radius"))
    return per_block(points, key, run, f"{doubles}, trunk_points long, crown_x double, crown_y double, crown_z double, crown_a double, crown_b double, crown_c double")


def compress_large(points: DataFrame, modes: int, landmarks: int = 1_000, near: int = 3, neighbours: int = 8, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """Coefficients (modes by three) of one mesh or cloud of any size (id, x, y, z) in smooth modes, and relative distortion, by Nystroem's extension.

    A bounded sample of landmarks (at most MOST_NODES, by hash of the id) makes a neighbour graph whose
    lowest modes are found densely; every point takes the weighted mean of its nearest landmarks'
    modes. Products of modes and positions are summed in each task, so only numbers of modes squared
    reach the driver, and no point is shuffled.
    """
    from weft.operators.sets import subsample

    n = _check(landmarks)
    marks = subsample(points.where("x is not null and y is not null and z is not null"), "id", n, seed).select("x", "y", "z").toPandas().to_numpy(float)
    n, k = len(marks), min(modes, len(marks))
    d = np.sqrt(np.maximum((marks**2).sum(1)[:, None] + (marks**2).sum(1) - 2 * marks @ marks.T, 0))
    np.fill_diagonal(d, np.inf)
    sigma = max(float(np.median(d.min(1))) if n > 1 else 1.0, 1e-12)
    w = np.zeros((n, n))
    for i in range(n):
        for j in np.argsort(d[i], kind="stable")[: min(neighbours, n - 1)]:
            w[i, j] = w[j, i] = math.exp(-d[i, j] ** 2 / (2 * sigma**2))
    low = np.linalg.eigh(np.diag(w.sum(1)) - w)[1][:, :k]
    shared = points.sparkSession.sparkContext.broadcast((marks, low))

    def sums(batches):
        import pyarrow as pa

        own, modes_of = shared.value
        total = np.zeros((k + 4, k + 4))
        for batch in batches:
            p = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            for a in range(0, len(p), 4_096):
                x = p[a : a + 4_096]
                gap = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (own**2).sum(1) - 2 * x @ own.T, 0))
                pick = np.argsort(gap, axis=1, kind="stable")[:, : min(near, len(own))]
                weight = 1 / (np.take_along_axis(gap, pick, 1) + 1e-9)
                phi = (modes_of[pick] * weight[:, :, None]).sum(1) / weight.sum(1, keepdims=True)
                row = np.concatenate([phi, x, np.ones((len(x), 1))], 1)
                total += row.T @ row
        i, j = np.divmod(np.arange(total.size), k + 4)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "s"])

    known = points.where("x is not null and y is not null and z is not null").select(*(F.col(c).cast("double").alias(c) for c in "xyz"))
    total = np.zeros((k + 4, k + 4))
    for r in known.mapInArrow(sums, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    gram, cross, square, mean, count = total[:k, :k], total[:k, k : k + 3], np.trace(total[k : k + 3, k : k + 3]), total[k : k + 3, k + 3], total[k + 3, k + 3]
    code = np.linalg.lstsq(gram, cross, rcond=None)[0]
    error, spread = max(0.0, square - 2 * (code * cross).sum() + (code * (gram @ code)).sum()), square - (mean**2).sum() / max(count, 1)
    return code, points.sparkSession.createDataFrame([(int(count), k, float(math.sqrt(error / spread)) if spread > 0 else 0.0)], "points long, modes long, distortion double")
