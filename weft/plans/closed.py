"""Queries of block, graph and stream operators whose results SQL knows in closed form, by enumeration or by unrolled rounds.

Graphs are paths of 5 to 9 nodes, one for each region, so that every block's answer is known exactly;
they are examples of fixed size, as blocks are.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators import blocks, fusion, graph, maxcal
from weft.plans.analytics import _MOMENTS, _moments, _RING, _ring, query, rounded
from weft.plans.wider import _COUNTS, _counts
from weft.sources import files
from weft.sources.tables import dimension, keep, shared_folder, table, write_bytes
from weft.streaming import state

# ---- paths: eigenvalues 2 - 2 cos(pi k / n), eigenvectors cosines ----

_PATH = "g as (select r_regionkey g, 5 + r_regionkey n from region), m as (select g, n, unnest(range(0, n)) k from g), l as (select g, n, k, 2 - 2 * cos(pi() * k / n) e from m), v as (select l.*, unnest(range(0, n)) i from l), phi as (select g, n, k, e, i, case when k = 0 then 1 / sqrt(n) else sqrt(2.0::double / n) * cos(pi() * k * (i + 0.5) / n) end f from v) "


def _up_to(last):
    return F.sequence(F.lit(0).cast("long"), last.cast("long"))


def _paths(spark, root):
    r = table(spark, root, "region").select(F.col("r_regionkey").alias("g"))
    return r.withColumn("src", F.explode(_up_to(F.col("g") + 3))).select("g", "src", (F.col("src") + 1).alias("dst"), F.lit(1.0).alias("w"))


@query(f"with {_PATH} select g, k mode, round(e, 8) + 0.0 eigenvalue from l")
def laplacian_eigenvalues(spark: SparkSession, root: str) -> DataFrame:
    return rounded(blocks.eigenvalues(_paths(spark, root), "g"), 8, "eigenvalue")


@query(f"with recursive {_PATH}, h(g, k, e, h, r) as (select g, k, e, exp(-1), 0 from l union all select g, k, e, exp(-1 - e / (2 * (1 + h))), r + 1 from h where r < 60) select g, k mode, round(e, 8) + 0.0 eigenvalue, round(h, 8) h, round(-1 / h + e / (2 * power(1 + h, 2)), 7) curvature from h where r = 60")
def spectral_state(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rounded(blocks.spectral_state(_paths(spark, root), "g"), 8, "eigenvalue", "h"), 7, "curvature")


@query(f"with recursive {_PATH}, f as (select *, unnest([0.1::double, 0.5, 1.0]) factor from l), h(g, k, e, factor, h, r) as (select g, k, e * factor, factor, exp(-1), 0 from f union all select g, k, e, factor, exp(-1 - e / (2 * (1 + h))), r + 1 from h where r < 60) select g, factor, round(max(case when k = 1 then e end), 8) fiedler, round(ln(sum(h)) - sum(h * ln(h)) / sum(h), 7) entropy, round(min(case when e > 1e-8 then 1 / h - e / (2 * power(1 + h, 2)) end), 7) gap from h where r = 60 group by g, factor")
def transition_sweep(spark: SparkSession, root: str) -> DataFrame:
    """All edges of each path weakened together, which scales its eigenvalues."""
    edges = _paths(spark, root).withColumn("weak", F.lit(True))
    return rounded(rounded(blocks.weakening_sweep(edges, "g", "weak", [0.1, 0.5, 1.0]), 8, "fiedler"), 7, "entropy", "gap")


@query(f"with {_PATH} select a.g, a.i, b.i j, round(sum(exp(-0.7 * a.e) * a.f * b.f), 8) + 0.0 k from phi a join phi b on a.g = b.g and a.k = b.k group by all")
def heat_kernel(spark: SparkSession, root: str) -> DataFrame:
    return rounded(blocks.spectral_kernel(_paths(spark, root), "g", 0.7), 8, "k")


_LABELS = "lab as (select g, i, unnest([{'c': 'a', 'p': (i + 1)::double / (n + 1)}, {'c': 'b', 'p': 1 - (i + 1)::double / (n + 1)}]) x from v where k = 0), co as (select phi.g, phi.k, phi.e, x.c, sum(f * x.p) s from phi join lab on lab.g = phi.g and lab.i = phi.i group by all), sm as (select phi.g, phi.i, co.c, sum({w} * s * f) p from phi join co on co.g = phi.g and co.k = phi.k group by all) "


def _labels(spark, root):
    nodes = table(spark, root, "region").select(F.col("r_regionkey").alias("g"), F.explode(_up_to(F.col("r_regionkey") + 4)).alias("node"))
    p = (F.col("node") + 1) / (F.col("g") + 6)
    return nodes.select("g", "node", F.explode(F.array(F.struct(F.lit("a").alias("cat"), p.alias("p")), F.struct(F.lit("b").alias("cat"), (1 - p).alias("p")))).alias("x")).select("g", "node", "x.cat", "x.p")


@query(f"with {_PATH}, {_LABELS.replace('{w}', '1 / (1 + 2 * co.e)')} select g, i node, c cat, round(p / sum(p) over (partition by g, i), 8) p from sm")
def smoothed_labels(spark: SparkSession, root: str) -> DataFrame:
    return rounded(blocks.smooth_labels(_paths(spark, root), _labels(spark, root), "g", 2.0), 8, "p")


@query(f"with {_PATH}, {_LABELS.replace('{w}', 'exp(-0.5 * co.e)')} select g, i node, c cat, round(p / sum(p) over (partition by g, i), 8) p from sm")
def heated_labels(spark: SparkSession, root: str) -> DataFrame:
    return rounded(blocks.smooth_labels(_paths(spark, root), _labels(spark, root), "g", 0.5, heat=True), 8, "p")


@query(f"with {_PATH}, x as (select g, i, i::double x, i * i / 10.0::double y from v where k = 0), mid as (select g, avg(x) mx, avg(y) my from x group by g), c as (select phi.g, k, sum(f * x) cx, sum(f * y) cy from phi join x on x.g = phi.g and x.i = phi.i where k < 3 group by all), t as (select x.g, sum(x * x + y * y) s, sum(power(x - mx, 2) + power(y - my, 2)) d from x join mid on mid.g = x.g group by x.g) select t.g, 3 modes, round(sqrt(greatest(0, s - (select sum(cx * cx + cy * cy) from c where c.g = t.g)) / d), 7) distortion from t")
def spectral_compression(spark: SparkSession, root: str) -> DataFrame:
    """Points along each path rebuilt from its three smoothest modes."""
    p = table(spark, root, "region").select(F.col("r_regionkey").alias("g"), F.explode(_up_to(F.col("r_regionkey") + 4)).alias("id"))
    p = p.select("g", "id", F.col("id").cast("double").alias("x"), (F.col("id") * F.col("id") / 10).alias("y"), F.lit(0.0).alias("z"))
    return rounded(blocks.compress_points(p, _paths(spark, root), "g", 3), 7, "distortion")


# ---- kernels ----

_TWO = "t as (select s_suppkey g, s_acctbal / 1000 a, (s_nationkey - 12) / 10.0::double b, (s_suppkey % 7 - 2)::double d from supplier), e as (select *, (a + d) / 2 m, sqrt(power((a - d) / 2, 2) + b * b) r from t) "


def _two_by_two(spark, root):
    s = table(spark, root, "supplier")
    a, b, d = F.col("s_acctbal") / 1000, (F.col("s_nationkey") - 12) / 10, (F.col("s_suppkey") % 7 - 2).cast("double")
    cells = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), k.alias("k")) for i, j, k in ((0, 0, a), (0, 1, b), (1, 0, b), (1, 1, d))))).alias("c")
    return s.select(F.col("s_suppkey").cast("string").alias("kernel_id"), cells).select("kernel_id", "c.*")


@query(f"with {_TWO}, p as (select g, m - r >= -1e-8 psd, a + d tr, greatest(m + r, 0) x, greatest(m - r, 0) y from e) select g::varchar kernel_id, psd, round(tr, 8) + 0.0 trace, round(case when x + y < 1e-10 then 0 else -(greatest(x / (x + y), 1e-10) * ln(greatest(x / (x + y), 1e-10)) + greatest(y / (x + y), 1e-10) * ln(greatest(y / (x + y), 1e-10))) end, 7) + 0.0 entropy from p")
def kernel_spectra(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rounded(blocks.kernel_spectra(_two_by_two(spark, root)).select("kernel_id", "psd", "trace", "entropy"), 8, "trace"), 7, "entropy")


@query(f"with {_TWO}, q as (select *, case when r > 0 then (a - m) / r else 1 end co, case when r > 0 then b / r else 0 end si, greatest(m + r, 0) x, greatest(m - r, 0) y from e) select g::varchar kernel_id, c.i, c.j, round(c.k, 8) + 0.0 k from (select g, unnest([{{'i': 0, 'j': 0, 'k': (x + y) / 2 + (x - y) / 2 * co}}, {{'i': 0, 'j': 1, 'k': (x - y) / 2 * si}}, {{'i': 1, 'j': 0, 'k': (x - y) / 2 * si}}, {{'i': 1, 'j': 1, 'k': (x + y) / 2 - (x - y) / 2 * co}}]) c from q)")
def projected_kernels(spark: SparkSession, root: str) -> DataFrame:
    return rounded(blocks.project_psd(_two_by_two(spark, root)), 8, "k")


@query(_MOMENTS + ", r as (select kernel_id, i, avg(k) a from m group by all), al as (select kernel_id, avg(k) a from m group by 1), z as (select m.kernel_id, m.i, m.j, m.k - x.a - y.a + al.a k from m join r x on x.kernel_id = m.kernel_id and x.i = m.i join r y on y.kernel_id = m.kernel_id and y.i = m.j join al on al.kernel_id = m.kernel_id) select a.kernel_id a, b.kernel_id b, round(sum(a.k * b.k) / sqrt(sum(a.k * a.k) * sum(b.k * b.k)), 6) cka from z a join z b on a.i = b.i and a.j = b.j and a.kernel_id < b.kernel_id group by all")
def kernel_alignment(spark: SparkSession, root: str) -> DataFrame:
    return rounded(blocks.alignment(keep(_moments(spark, root))), 6, "cka")


@query("with a as (select n_nationkey % 3 i, n_nationkey // 3 j, (n_nationkey % 3 * 2 + n_nationkey // 3 + 1)::double k from nation where n_nationkey < 9), b as (select n_nationkey % 2 i, n_nationkey // 2 j, (n_nationkey % 2 + 3 * (n_nationkey // 2) + 1)::double k from nation where n_nationkey < 4), q as (select a.k * b.k f, a.k * b.k + (a.i * 2 + b.i + a.j * 2 + b.j) % 3 k from a, b) select round(sqrt(sum(power(k - f, 2))) / (sqrt(sum(k * k)) + 1e-12), 8) relative from q")
def kernel_factorisation(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    a = n.where("n < 9").select((F.col("n") % 3).alias("i"), F.floor(F.col("n") / 3).alias("j"), (F.col("n") % 3 * 2 + F.floor(F.col("n") / 3) + 1).cast("double").alias("k"))
    b = n.where("n < 4").select((F.col("n") % 2).alias("i"), F.floor(F.col("n") / 2).alias("j"), (F.col("n") % 2 + 3 * F.floor(F.col("n") / 2) + 1).cast("double").alias("k"))
    cells = a.select(F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("k").alias("ka")).join(b.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("k").alias("kb")))
    joint = cells.select((F.col("ai") * 2 + F.col("bi")).alias("i"), (F.col("aj") * 2 + F.col("bj")).alias("j"), F.col("ka"), F.col("kb")).withColumn("k", F.col("ka") * F.col("kb") + (F.col("i") + F.col("j")) % 3).select("i", "j", "k")
    return rounded(blocks.factorisation(joint, a, b, 2), 8, "relative")


@query(_MOMENTS + ", s as (select kernel_id, i, sum(abs(k)) s, sum(case when k <> 0 then abs(k) * ln(abs(k)) else 0 end) e from m where i <> j group by all) select kernel_id, cast(count(*) as bigint) n, round(avg(ln(s) - e / s), 7) entropy from s group by kernel_id")
def coupling_entropy(spark: SparkSession, root: str) -> DataFrame:
    return rounded(blocks.coupling_entropy(keep(_moments(spark, root))), 7, "entropy")


@query("select s_suppkey, round(entropy, 8) + 0.0 entropy, round(lam, 8) fiedler, round(h1, 8) h_mean from (select *, -((n - 1) * p1 * ln(p1) + p0 * ln(p0)) entropy, ((n - 1) * h + exp(-1)) / n h1 from (select *, h / ((n - 1) * h + exp(-1)) p1, exp(-1) / ((n - 1) * h + exp(-1)) p0 from (select s_suppkey, n, n * c lam, exp(-1 - n * c / (1 + exp(-1))) h from (select s_suppkey, 3 + s_nationkey % 4 n, 1.0::double / (3 + s_nationkey % 4) c from supplier))))")
def attention_state(spark: SparkSession, root: str) -> DataFrame:
    """Heads that attend to every token alike, whose graphs are complete."""
    n = 3 + F.col("s_nationkey") % 4
    cells = table(spark, root, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), n * n - 1)).alias("x"), n.alias("n")).select("s_suppkey", F.floor(F.col("x") / F.col("n")).alias("i"), (F.col("x") % F.col("n")).cast("long").alias("j"), (1.0 / F.col("n")).alias("k"))
    return rounded(blocks.attention_state(cells, "s_suppkey"), 8, "entropy", "fiedler", "h_mean")


_SCALAR = "t as (select s_suppkey, (s_nationkey - 12) / 10.0::double a, 1 + s_suppkey % 3 b, 0.5::double q, 1 + s_suppkey % 2 r from supplier) select s_suppkey, round((a + sqrt(a * a + b * b * q / r)) * r / (b * b), 7) p from t"


def _scalar_systems(spark, root):
    one = lambda c: F.array(c.cast("double"))
    return table(spark, root, "supplier").select("s_suppkey", one((F.col("s_nationkey") - 12) / 10).alias("a"), one(1 + F.col("s_suppkey") % 3).alias("b"), one(F.lit(0.5)).alias("q"), one(1 + F.col("s_suppkey") % 2).alias("r"))


@query(f"with {_SCALAR}")
def riccati_gain(spark: SparkSession, root: str) -> DataFrame:
    return rounded(blocks.riccati(_scalar_systems(spark, root), "s_suppkey", 1).select("s_suppkey", F.col("p")[0].alias("p")), 7, "p")


@query(f"with {_SCALAR}")
def riccati_by_residual(spark: SparkSession, root: str) -> DataFrame:
    return rounded(blocks.fit_riccati(_scalar_systems(spark, root), "s_suppkey", 1).select("s_suppkey", F.col("p")[0].alias("p")), 7, "p")


@query("with t as (select s_suppkey, s_acctbal / 1000 z, exp(-0.5 * (power((s_nationkey % 5) / 2.0::double, 2) + power(0.5, 2))) c, 1 + 0.01 + 1e-8 v from supplier) select s_suppkey, round(c / v * z, 7) + 0.0 mean, round(sqrt(greatest(1 - c * c / v, 1e-12)), 7) std, round(-0.5 * z * z / v - 0.5 * ln(v) - 0.5 * ln(2 * pi()), 7) evidence from t")
def gp_posterior(spark: SparkSession, root: str) -> DataFrame:
    """One observation at the origin and one point to predict for each supplier."""
    s = table(spark, root, "supplier")
    seen = s.select("s_suppkey", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.col("s_acctbal") / 1000).alias("z"))
    asked = s.select("s_suppkey", F.lit(1).cast("long").alias("id"), (F.col("s_nationkey") % 5 / 2).alias("x"), F.lit(0.5).alias("y"), F.lit(None).cast("double").alias("z"))
    return rounded(blocks.gp_posterior(seen.unionByName(asked), "s_suppkey").select("s_suppkey", "mean", "std", "evidence"), 7, "mean", "std", "evidence")


@query(f"with {_COUNTS}, cod as (select user_id, n, [list_sum([x * cos(pi() * (i - 0.5) * k / 5) for x, i in n]) for k in range(0, 3)] code from d), back as (select user_id, code, [code[1] / 5 + 2.0 / 5 * (code[2] * cos(pi() * (i - 0.5) / 5) + code[3] * cos(pi() * (i - 0.5) * 2 / 5)) for x, i in n] back from cod) select user_id, round(code[1], 6) + 0.0 c0, round(code[2], 6) + 0.0 c1, round(code[3], 6) + 0.0 c2, round(back[1], 6) + 0.0 b0, round(back[5], 6) + 0.0 b4 from back")
def cosine_code(spark: SparkSession, root: str) -> DataFrame:
    c = blocks.cosine_code(_counts(spark, root), "user_id", "n", 3)
    return rounded(c.select("user_id", *(F.col("code")[k].alias(f"c{k}") for k in range(3)), F.col("rebuilt")[0].alias("b0"), F.col("rebuilt")[4].alias("b4")), 6, "c0", "c1", "c2", "b0", "b4")


# ---- meshes, cycles and small graphs ----


def _tori(spark, root):
    r = table(spark, root, "region").select(F.col("r_regionkey").alias("g"), (F.col("r_regionkey") + 3).alias("n"))
    cells = r.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") * F.col("n") - 1))).withColumn("i", F.floor(F.col("x") / F.col("n"))).withColumn("j", F.col("x") % F.col("n"))
    at = lambda di, dj: ((F.col("i") + di) % F.col("n") * F.col("n") + (F.col("j") + dj) % F.col("n")).cast("long")
    two = F.explode(F.array(F.struct(at(0, 0).alias("a"), at(1, 0).alias("b"), at(0, 1).alias("c")), F.struct(at(1, 0).alias("a"), at(1, 1).alias("b"), at(0, 1).alias("c")))).alias("f")
    return cells.select("g", two).select("g", "f.*")


@query("select r_regionkey g, power(r_regionkey + 3, 2)::bigint vertices, 3 * power(r_regionkey + 3, 2)::bigint edges, 2 * power(r_regionkey + 3, 2)::bigint faces, 1 beta0, 2 beta1, 1 beta2 from region")
def mesh_topology(spark: SparkSession, root: str) -> DataFrame:
    return blocks.mesh_topology(_tori(spark, root), "g")


@query("select r_regionkey g, unnest([0, 1, 2]) as \"rank\", unnest([1, 2, 1]) holes from region")
def hodge_holes(spark: SparkSession, root: str) -> DataFrame:
    """Zero eigenvalues of the Laplacians of tori are their Betti numbers."""
    return blocks.mesh_laplacians(_tori(spark, root), "g").where("eigenvalue < 1e-8").groupBy("g", "rank").agg(F.count("*").alias("holes"))


@query("with c as (select r_regionkey g, 4 + r_regionkey n, unnest(range(0, 4 + r_regionkey)) i from region), f as (select g, n, i, case when i = n - 1 then 0 else i end src, case when i = n - 1 then n - 1 else i + 1 end dst, ((i * 7 + g) % 5)::double w, case when i = n - 1 then -1 else 1 end s from c), h as (select *, avg(s * w) over (partition by g) m from f) select g, src, dst, round(w - s * m, 8) + 0.0 gradient, round(s * m, 8) + 0.0 harmonic from h")
def edge_decomposition(spark: SparkSession, root: str) -> DataFrame:
    """Flows on rings: what goes round is the mean of the flow along the ring, the rest is a potential's."""
    return rounded(blocks.edge_decomposition(_ring_flows(spark, root), "g"), 8, "gradient", "harmonic")


def _ring_flows(spark, root):
    c = table(spark, root, "region").select(F.col("r_regionkey").alias("g"), (F.col("r_regionkey") + 4).alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    last = F.col("i") == F.col("n") - 1
    return c.select("g", F.when(last, 0).otherwise(F.col("i")).cast("long").alias("src"), F.when(last, F.col("n") - 1).otherwise(F.col("i") + 1).cast("long").alias("dst"), ((F.col("i") * 7 + F.col("g")) % 5).cast("double").alias("w"))


@query("with c as (select r_regionkey g, 4 + r_regionkey n, unnest(range(0, 4 + r_regionkey)) i from region), f as (select g, n, ((i * 7 + g) % 5)::double w, case when i = n - 1 then -1 else 1 end s from c) select g, round(any_value(n) * power(avg(s * w), 2) / sum(w * w), 8) residual from f group by g")
def curl_energy(spark: SparkSession, root: str) -> DataFrame:
    return rounded(blocks.residual_share(blocks.edge_decomposition(_ring_flows(spark, root), "g"), "g"), 8, "residual")


_NATIONS = _RING.replace("with ", "with recursive ", 1) + ", w as (select src, dst, ((src * 7 + dst * 3) % 11 + 1 + src / 1000.0 + dst / 100000.0)::double w from e) "


def _weighted_ring(spark, root):
    w = (F.col("src") * 7 + F.col("dst") * 3) % 11 + 1 + F.col("src") / 1000 + F.col("dst") / 100000
    return _ring(spark, root).select(F.lit("n").alias("g"), "src", "dst", w.alias("w"))


@query(_NATIONS + ", lighter as (select a.src s, a.dst d, b.src, b.dst from w a join w b on b.w < a.w), ways as (select s, d, src x, dst y from lighter union all select s, d, dst, src from lighter), reach(s, d, pos) as (select src, dst, src from w union select r.s, r.d, ways.y from reach r join ways on ways.s = r.s and ways.d = r.d and ways.x = r.pos) select 'n' g, 0.0::double birth, w death from w where not exists (select 1 from reach r where r.s = w.src and r.d = w.dst and r.pos = w.dst) union all select 'n', 0.0, null")
def persistence_0d(spark: SparkSession, root: str) -> DataFrame:
    """Components of the ring of nations as edges come in by weight: an edge ends one where no lighter edges join its ends."""
    return blocks.persistence_0d(_weighted_ring(spark, root), "g")


@query(_RING.replace("with ", "with recursive ", 1) + ", walks(s, t, k) as (select i, i, 0 from d union all select walks.s, two.j, k + 1 from walks join two on two.i = walks.t where k < 8), c as (select s, t, k, count(*) n from walks group by all), sh as (select s, t, k, n from (select *, min(k) over (partition by s, t) low from c) where k = low) select 'n' g, v.i node, round(coalesce(sum(a.n * b.n / st.n::double) / 2, 0), 7) betweenness from d v left join (sh st join sh a on a.s = st.s join sh b on b.t = st.t and a.t = b.s and a.k + b.k = st.k) on a.t = v.i and st.s <> v.i and st.t <> v.i and st.s <> st.t group by v.i")
def betweenness(spark: SparkSession, root: str) -> DataFrame:
    """Shortest paths through each nation of the ring with chords, by counting walks."""
    return rounded(blocks.betweenness(_weighted_ring(spark, root), "g"), 7, "betweenness")


@query("with e as (select least(a, b) src, greatest(a, b) dst, (1 + (a * 3 + b * 5) % 7)::double w from (values (0, 1), (0, 2), (1, 2), (1, 3), (2, 4), (3, 4), (3, 5), (4, 6), (5, 6), (5, 7), (6, 7), (2, 5)) t(a, b)), cuts as (select range m from range(64)) select r_regionkey g, round(min(c) * (r_regionkey + 1), 6) flow from (select m, sum(case when (src = 0 or (src > 0 and src < 7 and (m >> (src - 1)) & 1 = 1)) <> (dst > 0 and dst < 7 and (m >> (dst - 1)) & 1 = 1) then w else 0 end) c from cuts, e group by m), region group by r_regionkey")
def max_flow(spark: SparkSession, root: str) -> DataFrame:
    """Largest flow of a small net, scaled for each region: the smallest of all 64 cuts."""
    pairs = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 4), (3, 4), (3, 5), (4, 6), (5, 6), (5, 7), (6, 7), (2, 5)]
    e = spark.createDataFrame([(a, b, 1.0 + (a * 3 + b * 5) % 7) for a, b in pairs], "src long, dst long, w double")
    nets = table(spark, root, "region").select(F.col("r_regionkey").alias("g")).join(e).withColumn("w", F.col("w") * (F.col("g") + 1))
    return rounded(blocks.max_flow(nets, "g", [0], [7]), 6, "flow")


@query("with g as (select r_regionkey g, 7 + r_regionkey n from region) select g, 0 removed, null::double node, (n * (n - 1) / 2)::bigint pairs from g union all select g, 1, ((n - 1) // 2)::double, (((n - 1) // 2) * ((n - 1) // 2 - 1) / 2 + (n - 1 - (n - 1) // 2) * (n - 2 - (n - 1) // 2) / 2)::bigint from g")
def fragmentation(spark: SparkSession, root: str) -> DataFrame:
    """The first node whose loss hurts a path most is the one in its middle."""
    r = table(spark, root, "region").select(F.col("r_regionkey").alias("g"))
    paths = r.withColumn("src", F.explode(_up_to(F.col("g") + 5))).select("g", "src", (F.col("src") + 1).alias("dst"), F.lit(1.0).alias("w"))
    return blocks.fragmentation(paths, "g", 1).withColumn("node", F.col("node").cast("double"))


@query(_NATIONS + ", two2 as (select src x, dst y, w from w union all select dst, src, w from w), far(node, d, k) as (select 0::bigint, 0.0::double, 0 union all select node, min(d), max(k) from (select two2.y node, far.d + two2.w d, k + 1 k from far join two2 on two2.x = far.node where k < 9) group by node) select 'n' g, node, round(min(d), 6) distance from far group by node")
def cheapest_paths(spark: SparkSession, root: str) -> DataFrame:
    return rounded(blocks.cheapest_paths(_weighted_ring(spark, root), "g", 0), 6, "distance")


@query(_RING + ", v0 as (select n_nationkey::bigint node, n_regionkey::double / 2 v from nation), v1 as (select i node, sum(p * v) * 2 / 0.9 v from m join v0 on j = node group by i), w1 as (select 0.5::double w0, 2 * 0.5 / 0.9::double w1), v2 as (select i node, sum(p * v) * 2 / 0.9 v from m join v1 on j = node group by i), w2 as (select w1, 2 * w1 / 0.9 - w0 w2 from w1) select node, round((v2.v - w2.x * v0.v) * 2, 7) + 0.0 v from v2 join v0 using (node), (select 0.5::double / (2 * (2 * 0.5 / 0.9::double) / 0.9 - 0.5) x) w2")
def chebyshev_mixing(spark: SparkSession, root: str) -> DataFrame:
    """Two accelerated rounds."""
    m = keep(graph.metropolis(_ring(spark, root)))
    v = table(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("double").alias("v"))
    return rounded(graph.chebyshev_mix(m, v, 0.9, 2), 7, "v")


def _parts_sql(steps: int) -> str:
    """Steps of a fluid of two parts and a rest unrolled."""
    sql = _RING + ", g as (select src, dst from e), dg as (select i node, d from d), r0 as (select n_nationkey::bigint node, part, case part when 'a' then 0.3 + 0.01 * n_nationkey else 0.2 end::double rho, case part when 'a' then n_regionkey / 5.0 else n_nationkey / 25.0 end::double phi from nation, (values ('a'), ('b')) p(part)), k0 as (select node, 1 - sum(rho) rho from r0 group by node), u0 as (select src, dst, part, 0.0::double u from g, (values ('a'), ('b')) p(part))"
    for k in range(steps):
        sql += f""", m{k} as (select node, part, sum(x) / any_value(d) nu from (select src node, part, -u x from u{k} union all select dst, part, u from u{k}) join dg using (node) group by node, part),
u{k + 1} as (select u.src, u.dst, u.part, u.u + 0.01 * (-((0.5 * b.rho + b.phi) - (0.5 * a.rho + a.phi)) - 0.8 * u.u + 0.15 * (q.nu - p.nu - 2 * u.u)) u, a.rho ra, b.rho rb from u{k} u join r{k} a on a.node = u.src and a.part = u.part join r{k} b on b.node = u.dst and b.part = u.part join m{k} p on p.node = u.src and p.part = u.part join m{k} q on q.node = u.dst and q.part = u.part),
f{k} as (select node, part, sum(x) gain from (select src node, part, -(ra + rb) / 2 * u x from u{k + 1} union all select dst, part, (ra + rb) / 2 * u from u{k + 1}) group by all),
t{k} as (select node, part, greatest(rho + 0.01 * coalesce(gain, 0), 1e-12) rho, phi from r{k} left join f{k} using (node, part)),
s{k} as (select node, sum(t.rho) + any_value(greatest(k.rho, 1e-12)) s from t{k} t join k{k} k using (node) group by node),
r{k + 1} as (select node, part, rho / s rho, phi from t{k} join s{k} using (node)), k{k + 1} as (select node, greatest(rho, 1e-12) / s rho from k{k} join s{k} using (node))"""
    return sql + f" select node, part, round(rho, 8) rho from r{steps} union all select node, null, round(rho, 8) from k{steps}"


@query(_parts_sql(2))
def fluid_of_parts(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("node"), "n_regionkey")
    a = n.select("node", F.lit("a").alias("part"), (0.3 + 0.01 * F.col("node")).alias("rho"), (F.col("n_regionkey") / 5).alias("phi"))
    b = n.select("node", F.lit("b").alias("part"), F.lit(0.2).alias("rho"), (F.col("node") / 25).alias("phi"))
    rest = n.select("node", F.lit(None).cast("string").alias("part"), (1 - (0.3 + 0.01 * F.col("node") + 0.2)).alias("rho"), F.lit(None).cast("double").alias("phi"))
    return rounded(graph.fluid_components(a.unionByName(b).unionByName(rest), _ring(spark, root).select("src", "dst", F.lit(1.0).alias("length")), 2), 8, "rho")


# ---- streams ----

_FRAMES = "f as (select run_id, t, avg(x) x, avg(y) y from rover_states where run_id is not null and t is not null and abs(x) < 1e6 and abs(y) < 1e6 group by all), o as (select run_id, row_number() over (partition by run_id order by t) - 1 n, x, y from f), d as (select *, case when n = 0 then 0 else sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) / sqrt(2.0::double) end d from o window w as (partition by run_id order by n)) "


def _frames(spark, root):
    f = table(spark, root, "rover_states").where("run_id is not null and t is not null and abs(x) < 1e6 and abs(y) < 1e6").groupBy("run_id", "t").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return f.select(F.col("run_id").alias("key"), (F.row_number().over(Window.partitionBy("run_id").orderBy("t")) - 1).cast("long").alias("frame"), F.array("x", "y").alias("vec"))


_TRACK = f"with {_FRAMES}, k as (select *, max(case when n = 0 or d >= 0.5 then n end) over (partition by run_id order by n) l, count(case when n > 0 then 1 end) over w c, count(case when n > 0 and d < 0.01 then 1 end) over w low, avg(case when n > 0 then d end) over w mean from d window w as (partition by run_id order by n rows between 4 preceding and current row)) select run_id as \"key\", n frame, round(d, 7) novelty, (n - l) % 11 = 0 keyframe, (n - l) % 11 since, round(case when c = 5 then greatest(0, 1 - mean / 0.01) else 0 end, 5) stability, c = 5 and low = 5 stable from k"


@query(_TRACK)
def frames_tracked(spark: SparkSession, root: str) -> DataFrame:
    """Novelty, keyframes and convergence of each run's positions."""
    t = state.track_frames_batch(_frames(spark, root), every=10, threshold=0.5, window=5, tol=0.01)
    return rounded(rounded(t.withColumn("stable", F.col("phase") == "stable_fp").drop("phase"), 7, "novelty"), 5, "stability")


def _streamed(spark: SparkSession, rows: DataFrame, order: str, batches: int, run, mode: str, name: str) -> DataFrame:
    """Rows of what a stream operator gives for rows that arrive in so many files, in order; its sink is a kept table written by each micro-batch."""
    ends = rows.agg(F.min(order), F.max(order)).first()
    width = ((ends[1] or 0) - (ends[0] or 0) + 1) / batches if ends[0] is not None else 1
    path = f"{shared_folder(spark)}/weft-stream-{name}"
    for k in range(batches):
        low = (ends[0] or 0) + k * width
        rows.where((F.col(order) >= low) & (F.col(order) < low + width)).coalesce(1).write.mode("append").parquet(path)
    told = run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path))
    write = lambda df, n: df.write.mode("append").parquet(f"{path}-out")
    told.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{path}-out")


@query(_TRACK)
def frames_streamed(spark: SparkSession, root: str) -> DataFrame:
    """The same frames through the stateful stream operator, in two micro-batches."""
    t = _streamed(spark, keep(_frames(spark, root)), "frame", 2, lambda s: state.track_frames(s, every=10, threshold=0.5, window=5, tol=0.01), "append", f"frames_{uuid.uuid4().hex}")
    return rounded(rounded(t.withColumn("stable", F.col("phase") == "stable_fp").drop("phase"), 7, "novelty"), 5, "stability")


@query(f"with {_FRAMES} select run_id as \"key\", n frame from (select *, row_number() over (partition by run_id order by n desc) r from d where n % 7 = 0) where r <= 5")
def keyframe_store(spark: SparkSession, root: str) -> DataFrame:
    """Every seventh frame of each run comes to a store of five."""
    return state.stored_keyframes(_frames(spark, root).where("frame % 7 = 0"), 5).select("key", "frame")


@query("select label::varchar label, count(*) n, round(avg(embedding[1]::double), 7) + 0.0 v0, round(avg(embedding[64]::double), 7) + 0.0 v63 from embeddings where label is not null and embedding is not null group by label")
def prototypes_streamed(spark: SparkSession, root: str) -> DataFrame:
    """Running means of each label's vectors from a stream, the last of each label."""
    e = keep(table(spark, root, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vec")))
    t = _streamed(spark, e, "vec_id", 3, lambda s: state.running_prototypes(s.select("label", "vec")), "update", f"prototypes_{uuid.uuid4().hex}")
    last = t.groupBy("label").agg(F.max(F.struct("n", "vec")).alias("m")).select("label", "m.n", F.col("m.vec")[0].alias("v0"), F.col("m.vec")[63].alias("v63"))
    return rounded(last, 7, "v0", "v63")


@query("select event_type, epoch_us(time_bucket(interval '6 hours', ts)) // 1000000 start, count(value) n, round(avg(value), 7) mean, round(var_samp(value), 6) variance from events where ts is not null group by all")
def windowed_moments(spark: SparkSession, root: str) -> DataFrame:
    w = state.windowed_moments(table(spark, root, "events").where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "6 hours")
    return rounded(rounded(w.select("event_type", F.unix_timestamp("window.start").alias("start"), "n", "mean", "variance"), 7, "mean"), 6, "variance")


@query("select 0.0::double + round((-0.5 + sqrt(0.25 + 0.5 * 4)) / 4, 3) gain, 'fitted' status")
def rotation_analyser(spark: SparkSession, root: str) -> DataFrame:
    """The last gain that the rotation-driven analyser finds for a known scalar system, x + (-0.5 x + 2 u): its Riccati equation has a closed answer."""
    x, rows = 0.0, []
    for n in range(60):
        u = 0.1 * np.sin(n * 1.7)
        rows.append(("r", n, float(n), [float(np.exp(x))], [float(u)]))
        x = x - 0.5 * x + 2 * u
    frames = keep(spark.createDataFrame(rows, "key string, rotation long, t double, h array<double>, u array<double>"))
    t = _streamed(spark, frames, "rotation", 3, lambda s: state.analyse_rotations(s, 1, 1, ridge=1e-9), "append", f"rotations_{uuid.uuid4().hex}")
    last = t.agg(F.max(F.struct("rotation", "status", "gain")).alias("m"))
    return rounded(last.select(F.col("m.gain")[0].alias("gain"), "m.status"), 3, "gain")


@query("select count(*) n, count(distinct event_type) kinds from events")
def callbacks(spark: SparkSession, root: str) -> DataFrame:
    """A function called with every micro-batch, which here keeps its rows."""
    name = f"callbacks_{uuid.uuid4().hex}"
    source, out = f"{shared_folder(spark)}/weft-{name}", f"{shared_folder(spark)}/weft-{name}-out"
    events = table(spark, root, "events").select("event_id", "event_type")
    events.repartition(3).write.mode("overwrite").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    state.call_back(stream, lambda df, n: df.write.mode("append").parquet(out), f"{shared_folder(spark)}/weft-{name}-log").awaitTermination()
    return spark.read.schema(events.schema).parquet(out).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"))


# ---- files ----


@query("select s_suppkey, 'edges' as \"name\", '<i4' kind, 2 * (1 + s_suppkey % 4) size, (power(s_suppkey % 4 + 1, 2))::double total from supplier union all select s_suppkey, 'weights', '<f8', 1 + s_suppkey % 4, round(s_acctbal * (1 + s_suppkey % 4), 4) from supplier union all select s_suppkey, 'positions', '<f4', 2, 1.5 from supplier")
def graph_streams(spark: SparkSession, root: str) -> DataFrame:
    """Small graphs packed as stream files and unpacked."""

    @F.pandas_udf("binary")
    def pack(key: pd.Series, weight: pd.Series) -> pd.Series:
        out = []
        for k, w in zip(key, weight):
            n = 1 + k % 4
            edges = np.stack([np.arange(n), np.arange(n) + 1], 1).astype("<i4")
            out.append(files.pack_stream({"nodes": n + 1, "modes": 0}, {"edges": edges, "weights": np.full(n, w), "positions": np.array([[0.5, 1.0]], "<f4")}))
        return pd.Series(out)

    s = table(spark, root, "supplier").select("s_suppkey", pack("s_suppkey", "s_acctbal").alias("packet"))
    return rounded(files.unpack_streams(s, "s_suppkey").select("s_suppkey", "name", "kind", F.size("data").alias("size"), F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total")), 4, "total")


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _square_tile(x: int, y: int, size: int) -> bytes:
    """A vector tile with one layer of extent 4096 and one square."""
    zig = lambda n: 2 * n if n >= 0 else -2 * n - 1
    held = lambda number, body: _varint(number << 3 | 2) + _varint(len(body)) + body
    geometry = b"".join(map(_varint, [9, zig(x), zig(y), 26, zig(size), zig(0), zig(0), zig(size), zig(-size), zig(0), 15]))
    return held(3, held(1, b"places") + held(2, _varint(3 << 3) + _varint(3) + held(4, geometry)) + _varint(5 << 3) + _varint(4096))


@query("select 3 zoom_level, n_nationkey::int tile_column, (n_nationkey % 5)::int tile_row, 'places' layer, 4 points, round((n_nationkey * 311 % 2048 + 50) / 4096.0::double, 8) x, round((n_nationkey * 523 % 2048 + 50) / 4096.0::double, 8) y from nation")
def tile_files(spark: SparkSession, root: str) -> DataFrame:
    """Vector tiles, one for each nation, written to a tile file (SQLite) and read again with their features' middles.

    Such a file needs a folder that executors share as a file system; elsewhere the tiles are decoded from the table.
    """
    keys = sorted(r[0] for r in dimension(table(spark, root, "nation").select("n_nationkey")).collect())
    rows = [(3, int(k), int(k) % 5, _square_tile(k * 311 % 2048, k * 523 % 2048, 100)) for k in keys]
    folder = shared_folder(spark)
    if folder.startswith("file:"):
        import sqlite3

        path = f"{folder.removeprefix('file://').removeprefix('file:')}/tiles-{uuid.uuid4().hex}.mbtiles"
        with sqlite3.connect(path) as db:
            db.execute("create table tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
            db.executemany("insert into tiles values (?, ?, ?, ?)", rows)
        db.close()
        tiles = files.read_tiles(spark, path)
    else:
        tiles = spark.createDataFrame(rows, "zoom_level int, tile_column int, tile_row int, tile_data binary")
    middle = lambda c: F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[c]) / F.size("ring")
    return rounded(files.tile_features(tiles).select("zoom_level", "tile_column", "tile_row", "layer", F.size("ring").alias("points"), middle("x").alias("x"), middle("y").alias("y")), 8, "x", "y")


@query("select i // 7 r, i % 7 c, round((i // 7 * 20) / 255.0::double, 7) red, round((i % 7 * 30) / 255.0::double, 7) green, round(i / 255.0::double, 7) blue from range(63) t(i)")
def image_pixels(spark: SparkSession, root: str) -> DataFrame:
    """A picture written as PNG and decoded by Spark's image source."""
    import struct
    import zlib

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + bytes(v for c in range(7) for v in (r * 20, c * 30, r * 7 + c)) for r in range(9))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    path = f"{shared_folder(spark)}/weft-image-{uuid.uuid4().hex}"
    write_bytes(spark, f"{path}/a.png", png)
    return rounded(files.read_images(spark, path).select("r", "c", "red", "green", "blue"), 7, "red", "green", "blue")


@query("select k channel, case k when 0 then 'EEG' else 'EMG' end label, i::bigint sample, round(i / 10.0::double, 6) t, round(((i * (k + 3) % 200 - 100) + 32768) / 65535.0::double * 200 - 100, 6) value from range(0, 30) s(i), range(0, 2) c(k)")
def sleep_recordings(spark: SparkSession, root: str) -> DataFrame:
    """A recording of two channels in European Data Format as a long table."""
    pad = lambda t, n: str(t).ljust(n).encode()
    columns = [("EEG", "EMG"), ("", ""), ("uV", "uV"), (-100, -100), (100, 100), (-32768, -32768), (32767, 32767), ("", ""), (10, 10), ("", "")]
    head = pad("0", 8) + pad("", 160) + pad("01.01.31", 8) + pad("00.00.00", 8) + pad(768, 8) + pad("", 44) + pad(3, 8) + pad(1, 8) + pad(2, 4) + b"".join(pad(v, w) for vs, w in zip(columns, (16, 80, 8, 8, 8, 8, 8, 80, 8, 32)) for v in vs)
    body = np.array([[[(i * (k + 3)) % 200 - 100 for i in range(n * 10, n * 10 + 10)] for k in range(2)] for n in range(3)], "<i2").tobytes()
    path = f"{shared_folder(spark)}/weft-edf-{uuid.uuid4().hex}"
    write_bytes(spark, f"{path}/a.edf", head + body)
    return rounded(files.read_edf(spark, path).select("channel", "label", "sample", "t", "value"), 6, "t", "value")


@query("select 'n' || n_nationkey id, 'node' what, n_name v from nation union all select 'n' || n_nationkey || '-r' || n_regionkey, 'edge', n_regionkey::varchar from nation")
def graphml_files(spark: SparkSession, root: str) -> DataFrame:
    """Nations and their regions written as GraphML and read again."""
    from xml.sax.saxutils import escape

    rows = dimension(table(spark, root, "nation").select("n_nationkey", "n_name", "n_regionkey")).orderBy("n_nationkey").collect()
    nodes = "".join(f'<node id="n{r[0]}"><data key="k0">{escape(r[1])}</data></node>' for r in rows)
    edges = "".join(f'<edge source="n{r[0]}" target="r{r[2]}"><data key="k1">{r[2]}</data></edge>' for r in rows)
    text = f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="k0" for="node" attr.name="name"/><key id="k1" for="edge" attr.name="region"/><graph>{nodes}{edges}</graph></graphml>'
    path = f"{shared_folder(spark)}/weft-graphml-{uuid.uuid4().hex}"
    write_bytes(spark, f"{path}/a.graphml", text.encode())
    n, e = files.read_graphml(spark, path)
    return n.select("id", F.lit("node").alias("what"), F.col("data")["name"].alias("v")).unionByName(e.select(F.concat_ws("-", "src", "dst").alias("id"), F.lit("edge").alias("what"), F.col("data")["region"].alias("v")))


# ---- choices and fits whose answers are known ----


@query("select 5000 draws, 5000 numbers, 0 strangers, true skewed")
def draws_with_replacement(spark: SparkSession, root: str) -> DataFrame:
    """Draws of customers in proportion to their balance: as many as asked for, none without weight, and the richer half more often."""
    c = table(spark, root, "customer").select("c_custkey", F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("p"))
    d = keep(maxcal.draw_with_replacement(c, "c_custkey", 5_000, 11)).join(c, "c_custkey")
    half = c.agg(F.percentile_approx("p", 0.5)).first()[0]
    return d.agg(F.count("*").alias("draws"), F.countDistinct("draw").alias("numbers"), F.count(F.when(F.col("p") <= 0, 1)).alias("strangers"), (F.count(F.when(F.col("p") > half, 1)) > 3_000).alias("skewed"))


@query("select r_regionkey g, round(2 + r_regionkey / 2.0::double, 2) a, round(1.5::double, 2) b, round(1.0::double, 2) c, 1.0::double e1, 1.0::double e2 from region")
def solid_fits(spark: SparkSession, root: str) -> DataFrame:
    """Ellipsoids found again from points on them."""
    turns = spark.range(24 * 12).select((2 * np.pi * (F.col("id") % 24 + 0.5) / 24).alias("u"), (np.pi * (F.floor(F.col("id") / 24) + 0.5) / 12).alias("v"))
    r = table(spark, root, "region").select(F.col("r_regionkey").alias("g"))
    p = r.join(turns).select("g", ((2 + F.col("g") / 2) * F.cos("u") * F.sin("v")).alias("x"), (1.5 * F.sin("u") * F.sin("v")).alias("y"), F.cos("v").alias("z"))
    return rounded(blocks.fit_solids(p, "g").select("g", "a", "b", "c", "e1", "e2"), 2, "a", "b", "c", "e1", "e2")


@query("select 's' m, 1.0::double birth, 1.5::double death")
def persistence_1d(spark: SparkSession, root: str) -> DataFrame:
    """A square of two triangles: its side closes a loop that the diagonal's faces fill; a hollow tetrahedron of equal sides has none that lasts."""
    rows = [("s", 0, 1, 2, 1.0, 1.0, 1.5), ("s", 0, 2, 3, 1.5, 1.0, 1.0)] + [("h", a, b, c, 1.0, 1.0, 1.0) for a, b, c in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))]
    return blocks.persistence_1d(spark.createDataFrame(rows, "m string, a long, b long, c long, ab double, bc double, ca double"), "m")


@query(f"with {_COUNTS} select user_id, array_to_string([lpad(printf('%x', cast(round_even(greatest(-1, least(1, x / list_max(n))) * 127, 0) + 128 as int)), 2, '0') for x in n], '') bytes, round(list_sum([abs(x - round_even(x / list_max(n) * 127, 0) / 127 * list_max(n)) for x in n]), 7) lost from d")
def spectrum_bytes(spark: SparkSession, root: str) -> DataFrame:
    """Each user's counts as one byte a number, and what that loses."""
    from weft.functions import coding

    top = F.array_max("n")
    c = _counts(spark, root).withColumn("bytes", coding.spectrum_bytes(F.col("n"), top)).withColumn("back", coding.bytes_spectrum(F.col("bytes"), top))
    lost = F.aggregate(F.zip_with("n", "back", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return rounded(c.select("user_id", "bytes", lost.alias("lost")), 7, "lost")


@query("select img, count(*) instances, sum(size)::bigint pixels from (select s_nationkey img, s_suppkey, 2 + s_suppkey % 3 size from supplier where s_suppkey % 4 <> 0) group by img")
def segmenter(spark: SparkSession, root: str) -> DataFrame:
    """Instances from a caller's segmenter over a table of images, here rows of bright and dark numbers."""
    s = table(spark, root, "supplier").select("s_nationkey", "s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.sequence(F.lit(1), 2 + F.col("s_suppkey") % 3)).otherwise(F.array().cast("array<bigint>")).alias("px"))

    def bright(pdf: pd.DataFrame, prompt: str | None) -> pd.DataFrame:
        rows = [(img, f"{prompt}-{k}", int(cell)) for img, k, px in zip(pdf["s_nationkey"], pdf["s_suppkey"], pdf["px"]) for cell in px]
        return pd.DataFrame(rows, columns=["img", "id", "cell"])

    found = fusion.segment(s, bright, "img int, id string, cell long", "lamp")
    return found.groupBy("img").agg(F.countDistinct("id").alias("instances"), F.count("*").alias("pixels"))


_CHAIN = "u as (select s_suppkey f, v, st, ((s_suppkey * 7 + v * 3 + st * 5) % 11) / 4.0::double x from supplier, range(0, 3) a(v), range(0, 3) b(st)), j as (select a.f, a.st sa, b.st sb, c.st sc, exp(a.x + b.x + c.x - 0.8 * abs(a.st - b.st) / 2.0 - 0.5 * abs(b.st - c.st) / 2.0) w from u a join u b on a.f = b.f and a.v = 0 and b.v = 1 join u c on c.f = a.f and c.v = 2), m as (select f, 0 v, sa st, sum(w) w from j group by all union all select f, 1, sb, sum(w) from j group by all union all select f, 2, sc, sum(w) from j group by all) "


@query(f"with {_CHAIN} select f || '-' || v as \"var\", st::varchar state, round(w / sum(w) over (partition by f, v), 5) p from m")
def belief_on_chains(spark: SparkSession, root: str) -> DataFrame:
    """Marginals of chains of three variables by messages, against all 27 joint states."""
    s = table(spark, root, "supplier").select(F.col("s_suppkey").alias("frame"))
    name = lambda v: F.concat_ws("-", F.col("frame").cast("string"), v.cast("string") if not isinstance(v, str) else F.lit(v))
    u = s.withColumn("v", F.explode(F.array(*map(F.lit, range(3))))).withColumn("st", F.explode(F.array(*map(F.lit, range(3)))))
    unary = u.select("frame", name(F.col("v")).alias("var"), F.col("st").cast("string").alias("state"), ((F.col("frame") * 7 + F.col("v") * 3 + F.col("st") * 5) % 11 / 4).alias("x"))
    pairs = s.select("frame", name("0").alias("a"), name("1").alias("b"), F.lit(0.8).alias("weight")).unionByName(s.select("frame", name("1").alias("a"), name("2").alias("b"), F.lit(0.5).alias("weight")))
    cost = spark.createDataFrame([(str(i), str(j), abs(i - j) / 2) for i in range(3) for j in range(3)], "s string, t string, cost double")
    return rounded(fusion.belief_propagation_in_frames(unary, pairs, cost, rounds=100, tol=1e-12), 5, "p")
