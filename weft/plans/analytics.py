"""Queries of the library's own operators over the test tables, each with the DuckDB SQL it is compared with.

Floats are rounded on both sides to about nine significant digits. Kernels between rows
take every id divisible by 100 as queries against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import coding, geodesy, indices, information, modes, motion, novelty, physics, shapes
from weft.operators import fusion, graph, kernels, maxcal, raster, spatial, stats, trajectory
from weft.sources.tables import keep, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounds columns; negative zero becomes zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


# ---- kernels over embeddings ----

_Q = "with q as (select vec_id i, embedding::double[] v from embeddings where vec_id % 100 = 0), r as (select vec_id j, embedding::double[] w from embeddings) "


def _vectors(spark, root):
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _gram(spark, root, kind, digits=6, **params):
    v = _vectors(spark, root)
    return rounded(kernels.gram(v.where("id % 100 = 0"), v, kind, **params), digits, "k")


@query(_Q + "select i, j, round(list_cosine_similarity(v, w), 6) + 0.0 k from q, r")
def gram_cosine(spark: SparkSession, root: str) -> DataFrame:
    return _gram(spark, root, "cosine")


@query(_Q + "select i, j, round(list_inner_product(v, w), 6) + 0.0 k from q, r")
def gram_linear(spark: SparkSession, root: str) -> DataFrame:
    return _gram(spark, root, "linear")


@query(_Q + "select i, j, round(exp(-greatest(0, list_inner_product(v, v) + list_inner_product(w, w) - 2 * list_inner_product(v, w)) / 8), 6) + 0.0 k from q, r")
def gram_rbf(spark: SparkSession, root: str) -> DataFrame:
    return _gram(spark, root, "rbf", length_scale=2.0)


@query(_Q + "select i, j, round(power(list_inner_product(v, w) + 1, 3), 5) + 0.0 k from q, r")
def gram_poly(spark: SparkSession, root: str) -> DataFrame:
    return _gram(spark, root, "poly", 5)


@query(_Q + "select i, j, round(exp(-list_sum([case when (x > 0.0) <> (w[n] > 0.0) then 1.0 else 0.0 end for x, n in v]) / 32.0), 6) + 0.0 k from q, r")
def gram_hamming_rbf(spark: SparkSession, root: str) -> DataFrame:
    return _gram(spark, root, "hamming_rbf", threshold=0.0, sigma=4.0)


@query(_Q + "select i, j, round(1.5 * exp(-0.5 * list_sum([power((x - w[n]) / (1 + (n - 1) / 64), 2) for x, n in v])), 6) + 0.0 k from q, r")
def gram_anisotropic(spark: SparkSession, root: str) -> DataFrame:
    return _gram(spark, root, "anisotropic", scales=[1 + n / 64 for n in range(64)], variance=1.5)


_MOMENTS = """with x as (select vec_id, label, cast(n - 1 as bigint) d, cast(e as double) x from (select vec_id, label, unnest(embedding) e, generate_subscripts(embedding, 1) n from embeddings)),
c as (select label, count(*) n from embeddings group by label),
m as (select cast(a.label as varchar) kernel_id, a.d i, b.d j, sum(a.x * b.x) / any_value(c.n) k from x a join x b using (vec_id) join c on a.label = c.label group by all) """


def _moments(spark, root):
    return kernels.moment_kernels(_vectors(spark, root), "label")


@query(_MOMENTS + "select kernel_id, i, j, round(k, 7) + 0.0 k from m")
def moment_kernel(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_moments(spark, root), 7, "k")


@query(_MOMENTS + "select kernel_id, i, j, round(2 * k + 3 * k * k, 6) + 0.0 k from m")
def kernel_algebra(spark: SparkSession, root: str) -> DataFrame:
    k, keys = keep(_moments(spark, root)), ("kernel_id", "i", "j")
    return rounded(kernels.kernel_sum(k, kernels.kernel_product(k, k, keys), 2.0, 3.0, keys), 6, "k")


@query(_MOMENTS + "select m.kernel_id, m.i, m.j, round(m.k / sqrt(a.k) / sqrt(b.k), 6) + 0.0 k from m join m a on a.kernel_id = m.kernel_id and a.i = m.i and a.j = m.i join m b on b.kernel_id = m.kernel_id and b.i = m.j and b.j = m.j")
def kernel_normalised(spark: SparkSession, root: str) -> DataFrame:
    return rounded(kernels.normalise(keep(_moments(spark, root))), 6, "k")


@query(_MOMENTS + "select kernel_id, max(i) + 1 n, round(sqrt(sum(k * k)) / sqrt(max(i) + 1), 6) norm from m group by kernel_id")
def hs_norm(spark: SparkSession, root: str) -> DataFrame:
    return rounded(kernels.hs_norm(_moments(spark, root)), 6, "norm")


_HS = "h as (select a.kernel_id a, b.kernel_id b, sqrt(sum(power(a.k - b.k, 2))) / sqrt(max(a.i) + 1) d from m a join m b on a.i = b.i and a.j = b.j and a.kernel_id < b.kernel_id group by all) "


@query(_MOMENTS + "," + _HS + "select a, b, round(d, 6) distance from h")
def hs_distance_labels(spark: SparkSession, root: str) -> DataFrame:
    return rounded(kernels.hs_distances(keep(_moments(spark, root))), 6, "distance")


@query(_MOMENTS + "," + _HS + "select a, b, round(1 / (1 + d), 6) similarity from h order by d, a, b limit 10")
def loop_closure_topk(spark: SparkSession, root: str) -> DataFrame:
    return rounded(kernels.loop_closures(kernels.hs_distances(keep(_moments(spark, root))), 10), 6, "similarity")


@query("""with x as (select vec_id, label, n, cast(e as double) x from (select vec_id, label, unnest(embedding) e, generate_subscripts(embedding, 1) n from embeddings)),
p as (select label, list(x order by n) v from (select label, n, avg(x) x from x group by all) group by label),
s as (select vec_id id, p.label, list_cosine_similarity(embedding::double[], v) similarity from embeddings, p),
b as (select *, row_number() over (partition by id order by similarity desc, label) r from s)
select id, label, round(similarity, 6) + 0.0 similarity, case when similarity >= 0.75 then 'known' when similarity >= 0.5 then 'uncertain' else 'unknown' end status from b where r = 1""")
def prototype_classify(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    return rounded(kernels.classify(v, kernels.prototypes(v, "label"), "id", "vec"), 6, "similarity")


_P = "with n as (select {k}, {c}, count(*) n from {t} where {k} is not null and {c} is not null group by all), p as (select {k}, {c}, n / sum(n) over (partition by {k}) p from n) "
_HELLINGER = "select a, b, round(s, 6) affinity, round(sqrt(1 - s), 5) hellinger, round(2 * acos(s), 5) fisher_rao from (select x.{k} a, y.{k} b, case when sum(sqrt(x.p * y.p)) >= 1 - 1e-9 then 1 else sum(sqrt(x.p * y.p)) end s from p x join p y using ({c}) where {w} group by all)"


@query(_P.format(k="user_id", c="event_type", t="events") + _HELLINGER.format(k="user_id", c="event_type", w="x.user_id % 100 = 0"))
def label_hellinger(spark: SparkSession, root: str) -> DataFrame:
    p = keep(kernels.distributions(table(spark, root, "events"), "user_id", "event_type"))
    return rounded(rounded(kernels.hellinger(p.where("user_id % 100 = 0"), p, "user_id", "event_type"), 6, "affinity"), 5, "hellinger", "fisher_rao")


@query(_P.format(k="source", c="lang", t="documents") + _HELLINGER.format(k="source", c="lang", w="x.source <= y.source"))
def hellinger_sources(spark: SparkSession, root: str) -> DataFrame:
    p = keep(kernels.distributions(table(spark, root, "documents"), "source", "lang"))
    return rounded(rounded(kernels.hellinger(p, p, "source", "lang").where("a <= b"), 6, "affinity"), 5, "hellinger", "fisher_rao")


# ---- trajectories over events ----

_KINDS = ["click", "error", "purchase", "signup", "view"]
_DAY = "cast(date_diff('day', date '1970-01-01', cast(ts as date)) as bigint)"
_SHARES = f"""with d as (select user_id, {_DAY} t, count(*) n, {', '.join(f"count(*) filter (event_type = '{k}') n{i}" for i, k in enumerate(_KINDS))} from events where user_id is not null and ts is not null group by all having {' + '.join(f"count(*) filter (event_type = '{k}')" for k in _KINDS)} > 0),
s as (select user_id, t, [{', '.join(f'n{i} / ({" + ".join(f"n{j}" for j in range(5))})' for i in range(5))}] v from d),
l as (select user_id, cast(t as double) t, v, lag(t) over w t0, lag(v) over w v0, row_number() over w - 1 step from s window w as (partition by user_id order by t)),
g as (select user_id, cast(step as int) step, cast(t0 as double) t0, t, sqrt(list_sum([power(x - v0[n], 2) for x, n in v])) / sqrt(5.0) d from l where step > 0) """


def _segments(spark, root):
    e = table(spark, root, "events")
    shares = trajectory.shares_in_time(e, "user_id", F.unix_date(F.to_date("ts")), "event_type", _KINDS)
    return trajectory.segments(shares, "user_id")


@query(_SHARES + "select user_id, step, t0, t, round(d, 6) distance, round(sum(d) over (partition by user_id order by step), 5) length, round(d / case when t = t0 then 1e-12 else t - t0 end, 6) speed from g")
def traj_segments(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rounded(_segments(spark, root), 6, "distance", "speed"), 5, "length")


@query(_SHARES + """, w as (select *, count(*) filter (d < 0.3) over (partition by user_id order by step rows between current row and 2 following) ahead, count(*) filter (d < 0.3) over (partition by user_id order by step rows between 2 preceding and current row) back, row_number() over (partition by user_id order by step desc) r from g)
select user_id, count(*) n_segments, round(sum(d), 5) path_length, max(case when r = 1 then back = 3 end) convergent, min(case when ahead = 3 then t0 end) convergence_time,
round(case when count(*) >= 3 and count(*) filter (d > 0) >= 2 then coalesce(-regr_slope(ln(d), (t0 + t) / 2) filter (d > 0), 0) else 0 end, 6) + 0.0 decay_rate from w group by user_id""")
def traj_summary(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rounded(trajectory.summary(_segments(spark, root), "user_id", 0.3, 3), 5, "path_length"), 6, "decay_rate")


@query(_SHARES + """, w as (select user_id, step, d, count(*) over b n, count(*) filter (d < 0.3) over b low, avg(d) over b mean, d - lag(d) over (partition by user_id order by step) rise, row_number() over (partition by user_id order by step desc) r from g window b as (partition by user_id order by step rows between 2 preceding and current row)),
x as (select *, max(rise) over (partition by user_id order by step rows between 1 preceding and current row) top from w)
select user_id, round(max(case when r = 1 then case when n >= 3 then greatest(0, 1 - mean / 0.3) else 0 end end), 5) stability,
max(case when r = 1 then case when n < 3 then 'insufficient_data' when low = 3 then 'stable_fp' when coalesce(top, 0) <= 0 then 'transient' else 'oscillating' end end) phase, cast(min(case when low = 3 then step end) as double) steps from x group by user_id""")
def fixed_point_state(spark: SparkSession, root: str) -> DataFrame:
    return rounded(trajectory.fixed_point_state(keep(_segments(spark, root)), "user_id", 0.3, 3), 5, "stability").withColumn("steps", F.col("steps").cast("double"))


@query("""with o as (select user_id, epoch(ts) / 86400 t, avg(value) v from events where ts is not null and value is not null group by all),
g as (select user_id, cast(unnest(range(cast(floor(min(t)) as bigint), cast(ceil(max(t)) as bigint) + 1)) as double) t from o group by user_id),
a as (select g.user_id, g.t, o.t t0, o.v v0 from g asof left join o on g.user_id = o.user_id and g.t >= o.t),
b as (select g.user_id, g.t, o.t t1, o.v v1 from g asof left join o on g.user_id = o.user_id and g.t <= o.t)
select user_id, t, round(case when t0 is null then v1 when t1 is null or t1 = t0 then v0 else v0 + (t - t0) / (t1 - t0) * (v1 - v0) end, 4) value from a join b using (user_id, t) where user_id is not null""")
def asof_interpolate(spark: SparkSession, root: str) -> DataFrame:
    """Values of each user at the midnights from the one before its first event to the one after its last."""
    e = table(spark, root, "events").where("user_id is not null and ts is not null and value is not null").select("user_id", (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 86_400e6).alias("t"), "value")
    span = e.groupBy("user_id").agg(F.floor(F.min("t")).alias("first"), F.ceil(F.max("t")).alias("last"))
    grid = span.select("user_id", F.explode(F.sequence("first", "last")).alias("t"))
    return rounded(trajectory.interpolate(e, grid, "user_id", "t", "value"), 4, "value")


@query("""with v as (select distinct sample_id, session_id, epoch_us("timestamp") / 1e6 t, power_watts v from power_samples where "timestamp" >= timestamp '2031-03-03' and "timestamp" < timestamp '2031-03-31' and power_watts is not null and not isnan(power_watts)),
a as (select session_id, (t - lag(t) over w) * (v + lag(v) over w) / 2 area from v window w as (partition by session_id order by t, v))
select session_id, count(*) n, round(coalesce(sum(area), 0), 2) energy from a group by session_id""")
def power_energy(spark: SparkSession, root: str) -> DataFrame:
    from weft.plans.problems import power_readings

    r = power_readings(spark, root, "interval_s").select("sample_id", "session_id", "micros", "power_watts").distinct()
    return rounded(trajectory.trapezoid(r, "session_id", F.col("micros") / 1e6, "power_watts"), 2, "energy")


@query("""with r as (select user_id, event_id, epoch_us(ts) t, value, row_number() over (partition by user_id order by epoch_us(ts), value) r, count(*) over (partition by user_id) n from events where ts is not null and value is not null),
q as (select user_id, quantile_cont(value, 0.1) h from r where r <= greatest(1, floor(n * 0.2)) group by user_id)
select user_id, round(any_value(h), 6) threshold, min(case when value < h then t end) first_t from r join q using (user_id) group by user_id""")
def first_crossing(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t"), "value")
    return rounded(trajectory.first_crossing(e, "user_id", "t", "value"), 6, "threshold")


@query("""select user_id, a_scene, event_type b_scene, count(*) n from (select user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) a_scene from events) where a_scene is not null and a_scene <> event_type group by all""")
def temporal_links(spark: SparkSession, root: str) -> DataFrame:
    links = fusion.temporal_links(table(spark, root, "events"), "user_id", ["ts", "event_id"], "event_type")
    return links.groupBy("user_id", "a_scene", "b_scene").agg(F.count("*").alias("n"))


@query("""with s as (select distinct state_id, run_id, t, v from rover_states where run_id is not null and t is not null and v is not null and abs(v) <= 100),
w as (select run_id, t, v, list(v) over (partition by run_id order by t, v, state_id rows between 149 preceding and current row) l from s)
select run_id, t, v, round(list_sum([0.3 * x * power(0.7, len(l) - n) for x, n in l]), 6) + 0.0 smooth from w""")
def speed_smoothing(spark: SparkSession, root: str) -> DataFrame:
    """Exponential smoothing of each run's possible speeds in order of time; in SQL by the weights of the last 150 readings, as older ones weigh below 1e-23."""
    states = table(spark, root, "rover_states").select("state_id", "run_id", "t", "v").where("abs(v) <= 100").distinct()
    return rounded(trajectory.ema(states, "run_id", "t", "v", 0.3), 6, "smooth")


# ---- aggregates ----


@query("select event_type, count(*) n, round(avg(value), 5) mean, round(stddev_samp(value), 5) std, round(median(value), 5) median from events where value is not null and event_type is not null group by event_type")
def stage_summary(spark: SparkSession, root: str) -> DataFrame:
    return rounded(stats.stage_summary(table(spark, root, "events"), "event_type", "value"), 5, "mean", "std", "median")


@query("""with e as (select event_type s, count(*)::double n, avg(value) m, var_samp(value) v from events where value is not null and event_type is not null group by 1)
select a.s a, b.s b, round(a.m - b.m, 5) + 0.0 delta, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) + 0.0 cohens_d, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 5) + 0.0 t, round(power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)), 3) df from e a join e b on a.s < b.s""")
def welch_contrast(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rounded(rounded(stats.welch_contrast(table(spark, root, "events"), "event_type", "value"), 5, "delta", "t"), 6, "cohens_d"), 3, "df")


@query("""with h as (select strftime(ts, '%Y-%m-%d') win, hour(ts) t, event_type c, avg(value) x from events where value is not null group by all),
z as (select win, t, h.c, (x - avg(x) over (partition by c)) / nullif(stddev_pop(x) over (partition by c), 0) z from h)
select a.win, a.c a, b.c b, round(covar_samp(a.z, b.z), 6) + 0.0 cov from z a join z b on a.win = b.win and a.t = b.t and a.c <= b.c group by all""")
def window_covariance(spark: SparkSession, root: str) -> DataFrame:
    hours = table(spark, root, "events").where("value is not null").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"), "event_type").agg(F.avg("value").alias("value"))
    return rounded(stats.window_covariance(hours, F.col("day"), "hour", "event_type", "value"), 6, "cov")


_MOM = "with m as (select {k}, count(*) n, sum({w}) weight, sum({w} * {x}) / sum({w}) mean, min({x}) low, max({x}) high from lineitem where {w} > 0 group by {k}), v as (select l.{k}, sum({w} * power({x} - mean, 2)) m2 from lineitem l join m using ({k}) where {w} > 0 group by l.{k}) "


@query(_MOM.format(k="l_returnflag", w="l_quantity", x="l_extendedprice") + "select l_returnflag, n, weight, round(mean, 4) mean, round(m2 / (weight - 1) / 1e6, 4) variance, low, high from m join v using (l_returnflag)")
def weighted_moments(spark: SparkSession, root: str) -> DataFrame:
    m = stats.weighted_moments(table(spark, root, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), F.col("l_quantity"))
    return rounded(m.withColumn("variance", F.col("variance") / 1e6), 4, "mean", "variance")


@query("""with x as (select l_suppkey k, 1 pid, l_discount x from lineitem union all select l_suppkey, 2, l_tax from lineitem union all select l_suppkey, 3, l_quantity from lineitem),
m as (select k, pid, count(*) n, avg(x) m, var_samp(x) v from x group by all)
select k, count(*) filter (n >= 2) properties, median(n)::double observations, round(coalesce(least(1, greatest(0, 1 - avg(case when n >= 2 then least(sqrt(v) / greatest(abs(m), 1e-3), 1) end))), 1), 6) confidence from m group by k""")
def packing_confidence(spark: SparkSession, root: str) -> DataFrame:
    props = F.explode(F.array(*(F.struct(F.lit(i).alias("pid"), F.col(c).alias("x")) for i, c in ((1, "l_discount"), (2, "l_tax"), (3, "l_quantity"))))).alias("p")
    each = table(spark, root, "lineitem").select(F.col("l_suppkey").alias("k"), props).select("k", "p.pid", "p.x")
    return rounded(stats.packing_confidence(stats.weighted_moments(each, ["k", "pid"], F.col("x"), F.lit(1.0)), "k", 2), 6, "confidence")


@query("""with s as (select l_returnflag g, p_brand b, sum(l_quantity) x from lineitem join part on l_partkey = p_partkey group by all), t as (select g, sum(x) t, count(*) n from s group by g)
select g, round(-sum(x / t * ln(x / t)), 6) raw, round(-sum(x / t * ln(x / t)) / ln(any_value(n)), 6) normalised, round(-sum(x / t * ln(x / t)) / ln(any_value(n)), 6) nonzero from s join t using (g) group by g""")
def spectral_entropy_variants(spark: SparkSession, root: str) -> DataFrame:
    shares = table(spark, root, "lineitem").join(table(spark, root, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_returnflag").alias("g"), "p_brand").agg(F.sum("l_quantity").alias("x"))
    spectra = shares.groupBy("g").agg(F.collect_list("x").alias("x"))
    return rounded(spectra.select("g", information.spectral_entropy(F.col("x")).alias("raw"), information.spectral_entropy(F.col("x"), True).alias("normalised"), information.nonzero_entropy(F.col("x")).alias("nonzero")), 6, "raw", "normalised", "nonzero")


@query("""with s as (select c_mktsegment g, strftime(o_orderdate, '%Y-%m') i, sum(o_totalprice) v from orders join customer on o_custkey = c_custkey group by all), r as (select *, row_number() over (partition by g order by v desc, i) r from s where v > 0),
p as (select g, r, v / sum(v) over (partition by g) p from r where r <= 20)
select a.g a, b.g b, round(greatest(0, 1 - sum(least(a.p, b.p))), 6) tv from p a join p b on a.r = b.r and a.g < b.g group by all""")
def topk_spectrum_tv(spark: SparkSession, root: str) -> DataFrame:
    monthly = table(spark, root, "orders").join(table(spark, root, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return rounded(stats.spectrum_distances(keep(stats.top_spectrum(monthly, "c_mktsegment", "month", F.col("o_totalprice"), 20)), "c_mktsegment"), 6, "tv")


@query("""select c_mktsegment, count(*) n, round(-regr_slope(ln(o_totalprice), date_diff('day', date '1990-01-01', cast(o_orderdate as date))), 8) + 0.0 rate, round(regr_r2(ln(o_totalprice), date_diff('day', date '1990-01-01', cast(o_orderdate as date))), 8) r2 from orders join customer on o_custkey = c_custkey where o_totalprice > 0 group by 1""")
def log_linear_fit(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").join(table(spark, root, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(stats.log_linear_fit(o, ["c_mktsegment"], F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")), F.col("o_totalprice")), 8, "rate", "r2")


@query("select event_type, count(*) n, round(regr_slope(ln(value), ln(event_id)), 7) + 0.0 exponent from events where value > 0 and event_id > 0 group by 1")
def power_law_fit(spark: SparkSession, root: str) -> DataFrame:
    return rounded(stats.power_law_fit(table(spark, root, "events"), ["event_type"], F.col("event_id"), F.col("value")), 7, "exponent")


@query("select l_shipmode_flag k, round(ln(sum(exp(l_quantity - 50))) + 50, 6) lse from (select l_returnflag || l_linestatus l_shipmode_flag, l_quantity from lineitem) group by 1")
def partition_function(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("k"), "l_quantity")
    return rounded(stats.logsumexp(rows, ["k"], F.col("l_quantity")), 6, "lse")


@query("with w as (select source, lang, sum(length(coalesce(text, ''))) w from documents where source is not null and lang is not null group by all) select source, lang, round(case when sum(w) over (partition by source) > 0 then w / sum(w) over (partition by source) else 0 end, 6) p from w")
def label_distribution(spark: SparkSession, root: str) -> DataFrame:
    return rounded(stats.label_distribution(table(spark, root, "documents"), "source", "lang", F.length(F.coalesce("text", F.lit("")))), 6, "p")


@query("select l_suppkey, count(*) n, round(avg(l_tax), 6) cost, round(avg(l_discount), 6) gain, round(case when avg(l_tax) > 0 then avg(l_discount) / avg(l_tax) else 0 end, 5) efficiency from lineitem group by 1")
def model_selection_stats(spark: SparkSession, root: str) -> DataFrame:
    each = table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_tax").alias("cost"), F.avg("l_discount").alias("gain"))
    return rounded(rounded(each.withColumn("efficiency", F.when(F.col("cost") > 0, F.col("gain") / F.col("cost")).otherwise(0.0)), 6, "cost", "gain"), 5, "efficiency")


@query("""with b as (select s_suppkey, abs(s_acctbal) c, 1 / (1 + s_nationkey) v from supplier), m as (select max(c) mc, max(v) mv from b), r as (select s_suppkey, 0.7 * c / (mc + 1e-8) + 0.3 * v / (mv + 1e-8) r from b, m)
select s_suppkey, round(r / ((select max(r) from r) + 1e-8), 6) reward from r""")
def assembly_reward(spark: SparkSession, root: str) -> DataFrame:
    return rounded(stats.reward(table(spark, root, "supplier"), "s_suppkey", F.abs("s_acctbal"), F.col("s_nationkey")), 6, "reward")


@query("""with s as (select distinct state_id, run_id, t, v, omega from rover_states where run_id is not null and t is not null and abs(v) <= 100 and abs(omega) <= 100),
p as (select run_id, v, omega, lead(v) over w v1, lead(omega) over w o1 from s window w as (partition by run_id order by t, state_id)),
g as (select run_id, count(*) n, sum(v * v) + 1e-9 a, sum(v * omega) b, sum(omega * omega) + 1e-9 d, sum(v1 * v) vv, sum(v1 * omega) vo, sum(o1 * v) ov, sum(o1 * omega) oo from p where v1 is not null group by run_id)
select run_id, n, round(((vv * d - vo * b) / (a * d - b * b) - 1) / 0.1, 5) + 0.0 a00, round((vo * a - vv * b) / (a * d - b * b) / 0.1, 5) + 0.0 a01, round((ov * d - oo * b) / (a * d - b * b) / 0.1, 5) + 0.0 a10, round(((oo * a - ov * b) / (a * d - b * b) - 1) / 0.1, 5) + 0.0 a11 from g""")
def rover_dynamics(spark: SparkSession, root: str) -> DataFrame:
    """Linear dynamics of (v, omega) of each run by least squares, the drift matrix as four columns."""
    rows = table(spark, root, "rover_states").select("state_id", "run_id", "t", "v", "omega").where("abs(v) <= 100 and abs(omega) <= 100").distinct()
    d = stats.autoregression(rows, "run_id", ["t", "state_id"], ["v", "omega"], 0.1, 1e-9)
    return rounded(d.select("run_id", "n", *(F.col("drift")[k].alias(f"a{k // 2}{k % 2}") for k in range(4))), 5, "a00", "a01", "a10", "a11")


# ---- columns ----


@query("""with e as (select event_id, case event_type when 'error' then 1.0 when 'signup' then 0.5 else 0.0 end s1, case when event_type <> 'view' then 1 / (1 + exp(-(value - 50) / 50)) end s2, case when value > 0 then 1 / (1 + exp(-abs(abs(value) - 10) / 10 / 0.5)) end s3 from events)
select event_id, round(1 - (1 - 0.5 * s1) * (1 - 0.3 * coalesce(s2, 0)) * (1 - 0.2 * coalesce(s3, 0)), 6) score from e""")
def soft_or_novelty(spark: SparkSession, root: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type") == "signup", "uncertain").otherwise("known")
    s2 = F.when(F.col("event_type") != "view", novelty.sigmoid((F.col("value") - 50) / 50))
    s3 = F.when(F.col("value") > 0, novelty.leakage_signal(F.col("value"), F.lit(10.0)))
    return rounded(table(spark, root, "events").select("event_id", novelty.soft_or([novelty.status_signal(status), s2, s3], [0.5, 0.3, 0.2]).alias("score")), 6, "score")


@query("""with s as (select distinct state_id, abs(v) / v_max n, greatest(0, 1 - abs(omega) / omega_max) st, 2 + abs(omega) cx, cast(state_id % 4 as int) k, v_max from rover_states join rovers using (rover_id) where v is not null and omega is not null and not isnan(v) and not isnan(omega)),
f as (select state_id, k, v_max, case when n <= 0.05 then 1.0 when n >= 0.8 then 0.1 else 0.1 + 0.9 * (1 - (n - 0.05) / 0.75) end fn, 0.25 + 0.75 * st fs, 0.15 + 0.85 * exp(-3 * greatest(cx - 2, 0) / (2 + 1e-9)) fc, case k when 2 then 1.0 when 1 then 0.3 when 3 then 0.0 else 0.1 end ft from s)
select state_id, round(fn, 9) f_novelty, round(fs, 9) f_stability, round(fc, 9) f_complexity, round(case when k = 3 then 0 when k <> 2 then least(0.1 + fn * fs * fc * ft * (v_max - 0.1), 0.2) else 0.1 + fn * fs * fc * ft * (v_max - 0.1) end, 9) v_target from f""")
def velocity_factors(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "rover_states").join(table(spark, root, "rovers").select("rover_id", "v_max", "omega_max"), "rover_id").where("v is not null and omega is not null and not isnan(v) and not isnan(omega)")
    s = s.select("state_id", "v_max", (F.abs("v") / F.col("v_max")).alias("n"), F.greatest(F.lit(0.0), 1 - F.abs("omega") / F.col("omega_max")).alias("st"), (2 + F.abs("omega")).alias("cx"), (F.col("state_id") % 4).cast("int").alias("k")).distinct()
    fn, fs, fc, ft = motion.novelty_factor(F.col("n")), motion.stability_factor(F.col("st")), motion.complexity_factor(F.col("cx")), motion.tracking_factor(F.col("k"))
    v = motion.target_speed(F.lit(0.1), F.col("v_max"), F.lit(0.2), F.col("k"), fn, fs, fc, ft)
    return rounded(s.select("state_id", fn.alias("f_novelty"), fs.alias("f_stability"), fc.alias("f_complexity"), v.alias("v_target")), 9, "f_novelty", "f_stability", "f_complexity", "v_target")


@query("select p_partkey, round((p_retailprice - p_size) / (p_retailprice + p_size), 6) ndvi, round(2.5 * (p_retailprice - p_size) / (p_retailprice + 6.0 * p_size - 7.5 * 10 + 1), 5) + 0.0 evi from part")
def vegetation_indices(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    return rounded(rounded(p.select("p_partkey", indices.ndvi(F.col("p_retailprice"), F.col("p_size")).alias("ndvi"), indices.evi(F.col("p_retailprice"), F.col("p_size"), F.lit(10.0)).alias("evi")), 6, "ndvi"), 5, "evi")


@query("""select o_orderkey, round(ln(o_totalprice) / ln(2), 6) bits, round(log10(1.380649e-23 * 298.15 * ln(o_totalprice)), 6) log_joules, round(log10(o_totalprice / (o_totalprice / (1.380649e-23 * 300 * ln(2)) )), 4) log10_ratio, case when o_totalprice = 0 then 'static_topology' when log10(o_totalprice / (o_totalprice / (1.380649e-23 * 300 * ln(2)))) > -15 then 'swaplimited_dynamic' else 'fundamentally_inaccessible' end regime from orders""")
def landauer_table(spark: SparkSession, root: str) -> DataFrame:
    o, nats = table(spark, root, "orders"), F.ln("o_totalprice")
    seen = physics.observability(F.col("o_totalprice"), F.col("o_totalprice"))
    return rounded(rounded(o.select("o_orderkey", physics.nats_to_bits(nats).alias("bits"), F.log10(physics.landauer_joules(nats)).alias("log_joules"), seen["log10_ratio"].alias("log10_ratio"), seen["regime"].alias("regime")), 6, "bits", "log_joules"), 4, "log10_ratio")


@query("""with b as (select node_id, region.geo_bbox g, list_filter(region.geo_polygon, lambda v: v is not null and v.lon is not null and v.lat is not null) p from scene_nodes where node_id is not null),
k as (select *, g.west is not null and g.south is not null and g.east is not null and g.north is not null and not (g.west = 0 and g.south = 0 and g.east = 0 and g.north = 0) boxed from b),
n as (select distinct node_id, case when boxed then (g.south + g.north) / 2 else (list_min([v.lat for v in p]) + list_max([v.lat for v in p])) / 2 end lat, case when boxed then (g.west + g.east) / 2 else (list_min([v.lon for v in p]) + list_max([v.lon for v in p])) / 2 end lon from k where boxed or len(p) > 0),
r as (select node_id, radians(lat) p, radians(lon) q, lon, lat, 6378137.0 / sqrt(1 - 0.0066943799901413165 * power(sin(radians(lat)), 2)) n from n)
select node_id, round((n + 100) * cos(p) * cos(q), 3) x, round((n + 100) * cos(p) * sin(q), 3) y, round((n * (1 - 0.0066943799901413165) + 100) * sin(p), 3) z, cast(floor((lon + 180) / 6) as int) % 60 + 1 zone, round(lat, 5) lat_back, round(lon, 5) lon_back from r""")
def geodesy_frames(spark: SparkSession, root: str) -> DataFrame:
    """Each placed node (by its box, else its ring) in geocentric coordinates and back, and its zone."""
    n = spatial.locate(table(spark, root, "scene_nodes"), "node_id", F.col("region.geo_bbox"), F.col("region.geo_polygon")).withColumnRenamed("id", "node_id")
    at = n.withColumn("e", geodesy.to_ecef(F.col("lat"), F.col("lon"), F.lit(100.0))).withColumn("g", geodesy.from_ecef(F.col("e.x"), F.col("e.y"), F.col("e.z")))
    return rounded(rounded(at.select("node_id", "e.x", "e.y", "e.z", geodesy.utm_zone(F.col("lon")).alias("zone"), F.col("g.lat").alias("lat_back"), F.col("g.lon").alias("lon_back")), 3, "x", "y", "z"), 5, "lat_back", "lon_back")


@query("""with z as (select distinct zone_id, geo_polygon p from survey_zones where len(geo_polygon) >= 3), e as (select zone_id, p[i] a, p[i % len(p) + 1] b from (select zone_id, p, unnest(range(1, len(p) + 1)) i from z))
select zone_id, round(abs(sum(a.lon * b.lat - b.lon * a.lat)) / 2, 6) area from e group by zone_id""")
def ring_areas(spark: SparkSession, root: str) -> DataFrame:
    z = table(spark, root, "survey_zones").where("size(geo_polygon) >= 3").select("zone_id", "geo_polygon").distinct()
    return rounded(z.select("zone_id", shapes.ring_area(F.col("geo_polygon"), "lon", "lat").alias("area")), 6, "area")


@query("""with c as (select distinct node_id, area from scene_nodes where area is not null), q as (select node_id, area, cast(round_even(least(1.0, greatest(0.0, area)) * 65535, 0) as bigint) code from c)
select node_id, code, round(code / 65535.0, 6) back, case when area < 0.05 then case when area < 0.0005 then 'Excellent' else 'Excellent' end when area < 0.15 then 'Good' when area < 0.35 then 'Fair' else 'Poor' end grade from q""")
def quantised_areas(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "scene_nodes").where("area is not null").select("node_id", "area").distinct().withColumn("code", coding.quantise_unsigned(F.col("area"), 2, 0.0, 1.0))
    return rounded(c.select("node_id", "code", coding.dequantise_unsigned(F.col("code"), 2, 0.0, 1.0).alias("back"), coding.grade(F.col("area")).alias("grade")), 6, "back")


@query("select p_partkey, 24 * p_size * 100 + 12 * p_size * 200 raw, round((24.0 * p_size * 100 + 12.0 * p_size * 200) / (32 * 64 + 12 * p_size * 200), 6) ratio, case when p_retailprice > 1500 then 'patch_request' when p_retailprice > 1200 then 'high' when p_retailprice > 1000 then 'medium' when p_size < 25 then 'skeleton_only' else 'low' end level from part")
def mesh_storage(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part").withColumn("v", F.col("p_size") * 100).withColumn("f", F.col("p_size") * 200)
    return rounded(p.select("p_partkey", coding.mesh_bytes(F.col("v"), F.col("f")).alias("raw"), coding.compression_ratio(F.col("v"), F.col("f"), F.lit(64)).alias("ratio"), coding.detail_level(F.col("p_retailprice"), F.col("p_size"), F.lit(25), 1500, 1200, 1000).alias("level")), 6, "ratio")


@query("""with recursive m as (select s_suppkey, s_nationkey + 1 n from supplier), f(s_suppkey, h0, h, k) as (select s_suppkey, cast(1.0 / n as double), exp(-1.0) / n, 0 from m union all select s_suppkey, h0, h0 * exp(-1 - 1 / (2 * (1 + h))), k + 1 from f where k < 40)
select s_suppkey, round(h, 8) h, round(-ln(h / h0) - 1 - 1 / (2 * (1 + h)), 8) + 0.0 residual, round(1 / h - 1 / (2 * power(1 + h, 2)), 6) margin, round(ln(1 + h) / 2, 8) info from f where k = 40""")
def mode_fixed_points(spark: SparkSession, root: str) -> DataFrame:
    h0 = 1.0 / (F.col("s_nationkey") + 1)
    s = table(spark, root, "supplier").select("s_suppkey", h0.alias("h0")).withColumn("h", modes.fixed_point(F.col("h0")))
    return rounded(rounded(s.select("s_suppkey", "h", modes.residual(F.col("h"), F.col("h0")).alias("residual"), modes.margin(F.col("h")).alias("margin"), modes.mode_information(F.col("h")).alias("info")), 8, "h", "residual", "info"), 6, "margin")


# ---- claims ----


def _claims(spark, root):
    nodes = table(spark, root, "scene_nodes").groupBy("node_id").agg(F.max_by(F.struct("sg_idx", "claims"), F.coalesce("ingested_at", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))).alias("n")).select("node_id", "n.sg_idx", "n.claims")
    return fusion.claims_of(nodes, "node_id", "sg_idx")


def _categories(claims):
    return claims.select(F.col("native_label").alias("cat")).where("cat is not null").distinct()


_CLAIMS = """with n as (select node_id, any_value(sg_idx) sg_idx, any_value(claims) claims from scene_nodes group by node_id),
c as (select node_id, sg_idx, i - 1 claim_no, claims[i].source_id s, claims[i].native_label l, claims[i].score score from (select *, unnest(range(1, len(claims) + 1)) i from n where len(claims) > 0)),
cats as (select distinct l cat from c where l is not null),
pr as (select s, l, cat, raw / sum(raw) over (partition by s, cat) q from (select s, l, cat, case when l = cat then 0.8 else 1 - 0.8 end raw from (select distinct s, l from c where s is not null and l is not null), cats)) """
_POST = """, e as (select node_id, cat, sum(score * ln(greatest(q, 1e-12))) x from c join pr using (s, l) group by all),
f as (select g.node_id, g.cat, coalesce(x, 0) x from (select node_id, cat from (select distinct node_id from c), cats) g left join e using (node_id, cat)),
po as (select node_id, cat, exp(x - max(x) over w) / sum(exp(x - mx)) over w p from (select *, max(x) over (partition by node_id) mx from f) window w as (partition by node_id)) """


@query(_CLAIMS + "select s source_id, count(*) n, round(avg(score), 6) score from c where score >= 0.5 and s in ('osm', 'textbox', 'segany') group by s")
def claim_filter(spark: SparkSession, root: str) -> DataFrame:
    kept = fusion.filter_claims(_claims(spark, root), 0.5, ["osm", "textbox", "segany"])
    return rounded(kept.groupBy("source_id").agg(F.count("*").alias("n"), F.avg("score").alias("score")), 6, "score")


@query(_CLAIMS + _POST + "select node_id, cat, round(p, 5) p from (select *, row_number() over (partition by node_id order by round(p, 9) desc, cat) r from po) where r = 1")
def claim_posterior(spark: SparkSession, root: str) -> DataFrame:
    c = keep(_claims(spark, root))
    cats = keep(_categories(c))
    post = fusion.posteriors(c, fusion.confusion_prior(c, cats), None, ["node_id"], cats)
    return rounded(fusion.argmax(post.withColumn("p", F.round("p", 9)), ["node_id"], "p", "cat"), 5, "p")


@query(_CLAIMS + _POST + "select cat, count(*) n from (select *, row_number() over (partition by node_id order by round(p, 9) desc, cat) r from po) where r = 1 group by cat")
def category_histogram(spark: SparkSession, root: str) -> DataFrame:
    return claim_posterior(spark, root).groupBy("cat").agg(F.count("*").alias("n"))


_EVIDENCE = ", b as (select node_id, l cat from (select *, row_number() over (partition by node_id order by score desc, claim_no) r from c where l is not null and score is not null) where r = 1), n2 as (select s, l, cat, sum(score) n from c join b using (node_id) where s is not null and l is not null and score is not null group by all) "


def _evidence(c):
    best = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("score"), "claim_no"))
    top = c.where("native_label is not null and score is not null").withColumn("r", best).where("r = 1").select("node_id", F.col("native_label").alias("cat"))
    said = c.where("source_id is not null and native_label is not null and score is not null").join(top, "node_id")
    return said.select(F.col("source_id").alias("source"), F.col("native_label").alias("label"), "cat", F.col("score").alias("w"))


@query(_CLAIMS + _EVIDENCE + "select s source, l label, cat, round(n, 5) n from n2")
def evidence_counts(spark: SparkSession, root: str) -> DataFrame:
    c = keep(_claims(spark, root))
    return rounded(stats.evidence_counts(_evidence(c), fusion.confusion_prior(c, keep(_categories(c)))), 5, "n")


@query(_CLAIMS + _EVIDENCE + "select s source, l label, cat, round((10 * q + coalesce(n, 0)) / sum(10 * q + coalesce(n, 0)) over (partition by s, cat), 7) q from pr left join n2 using (s, l, cat)")
def dirichlet_refit(spark: SparkSession, root: str) -> DataFrame:
    c = keep(_claims(spark, root))
    prior = keep(fusion.confusion_prior(c, keep(_categories(c))))
    return rounded(stats.dirichlet_refit(prior, stats.evidence_counts(_evidence(c), prior)), 7, "q")


@query()
def source_weights(spark: SparkSession, root: str) -> DataFrame:
    """Weights of sources by expectation maximisation; iterative, so without SQL."""
    c = keep(_claims(spark, root))
    cats = keep(_categories(c))
    lam, _ = fusion.fit_sources(c, keep(fusion.confusion_prior(c, cats)), cats, "node_id")
    return spark.createDataFrame(sorted(lam.items()), "source string, weight double")


_BOXES = "with b as (select distinct sg_idx, node_id, least(bbox.x1, bbox.x2) x1, least(bbox.y1, bbox.y2) y1, greatest(bbox.x1, bbox.x2) x2, greatest(bbox.y1, bbox.y2) y2 from scene_nodes where bbox.x1 is not null and bbox.y1 is not null and bbox.x2 is not null and bbox.y2 is not null) "


def _boxes(spark, root):
    b = F.col("bbox")
    box = F.struct(F.least(b["x1"], b["x2"]).alias("x1"), F.least(b["y1"], b["y2"]).alias("y1"), F.greatest(b["x1"], b["x2"]).alias("x2"), F.greatest(b["y1"], b["y2"]).alias("y2"))
    return table(spark, root, "scene_nodes").where("bbox.x1 is not null and bbox.y1 is not null and bbox.x2 is not null and bbox.y2 is not null").select("sg_idx", F.col("node_id").alias("id"), box.alias("box")).distinct()


@query(_BOXES + """, p as (select sg_idx, a.node_id a, b.node_id b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) w, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) u from b a join b using (sg_idx) where a.node_id < b.node_id)
select sg_idx, a, b, round(w / (u - w), 6) iou from p where u > w and w / (u - w) >= 0.02""")
def iou_pairs(spark: SparkSession, root: str) -> DataFrame:
    return rounded(fusion.iou_pairs(_boxes(spark, root), ["sg_idx"], 0.02), 6, "iou")


_ADJ = ", p as (select sg_idx, a.node_id a, b.node_id b, sqrt(power((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + power((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) d from b a join b using (sg_idx) where a.node_id < b.node_id), adj as (select * from p where d <= 0.25) "


@query(_BOXES + _ADJ + "select sg_idx, a, b, round(d, 6) distance, round(1 - d / 0.25, 6) weight from adj")
def adjacency_pairs(spark: SparkSession, root: str) -> DataFrame:
    return rounded(fusion.adjacency(_boxes(spark, root), ["sg_idx"], 0.25), 6, "distance", "weight")


@query(_BOXES + _ADJ + """, w as (select sg_idx, a, b, 1 - d / 0.25 w from adj union all select sg_idx, b, a, 1 - d / 0.25 from adj), r as (select *, row_number() over (partition by sg_idx, a order by w desc, b) r from w)
select sg_idx frame, least(a, b) a, greatest(a, b) b from r where r <= 2 group by all having count(*) = 2""")
def degree_capped(spark: SparkSession, root: str) -> DataFrame:
    adj = fusion.adjacency(_boxes(spark, root), ["sg_idx"], 0.25).select(F.col("sg_idx").alias("frame"), "a", "b", "weight")
    return fusion.capped_degree(adj, 2).select("frame", "a", "b")


_CLUSTERS = ", o as (select *, (x2 - x1) * (y2 - y1) area, row_number() over (partition by sg_idx order by (x2 - x1) * (y2 - y1) desc, node_id) r from b), "


@query(_BOXES.replace("with ", "with recursive ", 1) + _CLUSTERS + """s(sg_idx, r, anchors, node_id, cluster) as (select sg_idx, r, [{'id': node_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}], node_id, node_id from o where r = 1 union all
select sg_idx, r, case when best > 0.05 then anchors else list_append(anchors, {'id': node_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) end, node_id, case when best > 0.05 then anchors[list_position(ious, best)].id else node_id end from (select *, list_max(ious) best from (
 select o.*, s.anchors, [case when least(o.x2, a.x2) > greatest(o.x1, a.x1) and least(o.y2, a.y2) > greatest(o.y1, a.y1) and (o.x2 - o.x1) * (o.y2 - o.y1) + (a.x2 - a.x1) * (a.y2 - a.y1) - (least(o.x2, a.x2) - greatest(o.x1, a.x1)) * (least(o.y2, a.y2) - greatest(o.y1, a.y1)) > 0
   then (least(o.x2, a.x2) - greatest(o.x1, a.x1)) * (least(o.y2, a.y2) - greatest(o.y1, a.y1)) / ((o.x2 - o.x1) * (o.y2 - o.y1) + (a.x2 - a.x1) * (a.y2 - a.y1) - (least(o.x2, a.x2) - greatest(o.x1, a.x1)) * (least(o.y2, a.y2) - greatest(o.y1, a.y1))) else 0.0 end for a in s.anchors] ious
 from s join o on s.sg_idx = o.sg_idx and o.r = s.r + 1))) select sg_idx, node_id claim_id, cluster from s""")
def claim_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of each scene clustered greedily by overlap, from the largest."""
    b = _boxes(spark, root).where("sg_idx is not null").select("sg_idx", F.col("id").alias("claim_id"), "box", ((F.col("box.x2") - F.col("box.x1")) * (F.col("box.y2") - F.col("box.y1"))).alias("area"))
    return fusion.cluster_claims(b, ["sg_idx"], 0.05)


@query("""with n as (select distinct node_id, osm_id from scene_nodes where osm_id is not null) select osm_id, count(*) n, min(node_id) entity from n group by osm_id having count(*) > 1""")
def shared_feature_ids(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "scene_nodes").where("osm_id is not null").select("node_id", "osm_id").distinct()
    return n.groupBy("osm_id").agg(F.count("*").alias("n"), F.min("node_id").alias("entity")).where("n > 1")


@query()
def loopy_bp(spark: SparkSession, root: str) -> DataFrame:
    """Fused category of each node after messages between neighbours of its scene; iterative, so without SQL."""
    c = keep(_claims(spark, root))
    cats = keep(_categories(c))
    scenes = c.select("node_id", F.col("sg_idx").alias("frame")).distinct()
    unary = fusion.posteriors(c, fusion.confusion_prior(c, cats), None, ["node_id"], cats).join(scenes, "node_id")
    unary = keep(unary.select("frame", F.col("node_id").alias("var"), F.col("cat").alias("state"), F.col("log_score").alias("x")))
    pairs = fusion.adjacency(_boxes(spark, root), ["sg_idx"], 0.15).select(F.col("sg_idx").alias("frame"), "a", "b", "weight")
    d = fusion.category_distances(cats.select("cat", F.substring("cat", 1, 1).alias("super"))).select(F.col("a").alias("s"), F.col("b").alias("t"), F.col("d").alias("cost"))
    return rounded(fusion.argmax(fusion.belief_propagation_in_frames(unary, pairs, keep(d)), ["var"], "p", "state"), 5, "p")


# ---- graphs ----

_KNN = _Q + ", d as (select i, j, sqrt(greatest(0, list_inner_product(v, v) + list_inner_product(w, w) - 2 * list_inner_product(v, w))) d from q, r where i <> j), k as (select i, j, d, row_number() over (partition by i order by d, j) r from d), e as (select least(i, j) src, greatest(i, j) dst, max(exp(-d * d / 8)) w from k where r <= 5 group by all) "


def _knn(spark, root):
    v = _vectors(spark, root)
    return graph.nearest(v.where("id % 100 = 0"), v, 5)


@query(_KNN + "select i query, j id, cast(r as int) rank, round(d, 6) distance from k where r <= 5")
def knn_join(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_knn(spark, root), 6, "distance")


@query(_KNN + "select src, dst, round(w, 7) w from e")
def knn_graph(spark: SparkSession, root: str) -> DataFrame:
    return rounded(graph.gaussian_edges(_knn(spark, root), 2.0), 7, "w")


@query(_KNN + ", b as (select src i, dst j, w from e union all select dst, src, w from e) select i, j, round(-w, 7) + 0.0 k from b union all select i, i, round(sum(w), 6) from b group by i")
def laplacian_edges(spark: SparkSession, root: str) -> DataFrame:
    lap = graph.laplacian(keep(graph.gaussian_edges(_knn(spark, root), 2.0)))
    return lap.withColumn("k", F.when(F.col("i") == F.col("j"), F.round("k", 6)).otherwise(F.round("k", 7)) + F.lit(0.0))


@query(_KNN + "select round(sum(e.w * (power(a.label - b.label, 2) + power(a.embedding[1]::double - b.embedding[1]::double, 2))) / ((select count(*) from embeddings) * 2), 8) energy from e join embeddings a on a.vec_id = src join embeddings b on b.vec_id = dst")
def dirichlet_energy(spark: SparkSession, root: str) -> DataFrame:
    v = table(spark, root, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("e0"))
    return rounded(graph.dirichlet_energy(graph.gaussian_edges(_knn(spark, root), 2.0), v, "vec_id", ["label", "e0"]), 8, "energy")


_REACH = ", nodes as (select distinct node_id from scene_nodes where bbox.x1 is not null and bbox.y1 is not null and bbox.x2 is not null and bbox.y2 is not null), two as (select a, b from adj union all select b, a from adj), reach(s, t) as (select node_id, node_id from nodes union select r.s, two.b from reach r join two on r.t = two.a), comp as (select s node, min(t) component from reach group by s) "


def _scene_graph(spark, root):
    adj = keep(fusion.adjacency(_boxes(spark, root), ["sg_idx"], 0.25))
    edges = graph.canonical(adj.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").alias("w")))
    return _boxes(spark, root).select(F.col("id").alias("node")).distinct(), keep(edges)


@query(_BOXES.replace("with ", "with recursive ", 1) + _ADJ + _REACH + "select node, component from comp")
def connected_components(spark: SparkSession, root: str) -> DataFrame:
    nodes, edges = _scene_graph(spark, root)
    return graph.components(nodes, edges)


@query(_BOXES.replace("with ", "with recursive ", 1) + _ADJ + _REACH + "select count(*) n, (select count(*) from adj) e, count(distinct component) beta0, greatest(0, (select count(*) from adj) - count(*) + count(distinct component)) beta1 from comp")
def components_betti(spark: SparkSession, root: str) -> DataFrame:
    nodes, edges = _scene_graph(spark, root)
    return graph.betti(nodes, edges).select("n", "e", "beta0", "beta1")


@query(_BOXES.replace("with ", "with recursive ", 1) + _ADJ + """, deg as (select node, count(*) d from (select a node from adj union all select b from adj) group by node), top as (select node from deg order by d desc, node limit 10),
left_ as (select a, b from adj where a not in (select node from top) and b not in (select node from top)), nodes as (select distinct node_id from b where node_id not in (select node from top)), two as (select a, b from left_ union all select b, a from left_),
reach(s, t) as (select node_id, node_id from nodes union select r.s, two.b from reach r join two on r.t = two.a), comp as (select s, min(t) c from reach group by s)
select cast(sum(n * (n - 1) / 2) as bigint) pairs from (select c, count(*) n from comp group by c)""")
def pairwise_connectivity(spark: SparkSession, root: str) -> DataFrame:
    nodes, edges = graph.without_top(*_scene_graph(spark, root), 10)
    return graph.pairwise_connectivity(graph.components(nodes, edges))


_RING = "with e as (select least(n_nationkey, (n_nationkey + 1) % 25)::bigint src, greatest(n_nationkey, (n_nationkey + 1) % 25)::bigint dst from nation union select n_nationkey, n_nationkey + 7 from nation where n_nationkey < 12), two as (select src i, dst j from e union all select dst, src from e), d as (select i, count(*) d from two group by i), o as (select two.i, two.j, 1.0::double / (1 + greatest(a.d, b.d)) p from two join d a on a.i = two.i join d b on b.i = two.j), m as (select i, j, p from o union all select i, i, 1 - sum(p) from o group by i) "


def _ring(spark, root):
    n = table(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    ring = n.select(F.col("a").alias("src"), ((F.col("a") + 1) % 25).alias("dst")).unionByName(n.where("a < 12").select(F.col("a").alias("src"), (F.col("a") + 7).alias("dst")))
    return graph.canonical(ring)


@query(_RING + "select i, j, round(p, 8) p from m")
def gossip_weights(spark: SparkSession, root: str) -> DataFrame:
    return rounded(graph.metropolis(_ring(spark, root)), 8, "p")


@query(_RING + ", v0 as (select n_nationkey::bigint node, n_regionkey::double v from nation), v1 as (select i node, sum(p * v) v from m join v0 on j = node group by i) select i node, round(sum(p * v), 7) v from m join v1 on j = node group by i")
def gossip_round(spark: SparkSession, root: str) -> DataFrame:
    m = keep(graph.metropolis(_ring(spark, root)))
    v = table(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("double").alias("v"))
    return rounded(graph.mix(m, graph.mix(m, v)), 7, "v")


@query(_RING.replace("with ", "with recursive ", 1) + ", far(node, source, d) as (select 0::bigint, 0::bigint, 0 union select two.j, source, d + 1 from far join two on two.i = far.node where d < 13) select node, source, min(d)::double distance from far group by all")
def shortest_distances(spark: SparkSession, root: str) -> DataFrame:
    return graph.distances(_ring(spark, root), spark.range(1).select(F.col("id").alias("node")))


def _fluid_sql(steps: int) -> str:
    """The fluid's steps unrolled: velocities and densities of one step from those of the one before."""
    sql = _RING + ", g as (select src, dst, 1.0::double len from e), deg as (select i node, d from d), r0 as (select n_nationkey::bigint node, 1.0::double / 25 rho, n_regionkey / 5.0::double + 1.2 * n_nationkey / 25.0::double - 0.9 * 0.2::double phi from nation), u0 as (select src, dst, len, 0.0::double u from g)"
    for k in range(steps):
        sql += f""", m{k} as (select node, sum(x) / any_value(d) nu from (select src node, -u x from u{k} union all select dst, u from u{k}) join deg using (node) group by node),
u{k + 1} as (select u.src, u.dst, u.len, u.u + 0.01 * (-((0.5 * b.rho + b.phi) - (0.5 * a.rho + a.phi)) / u.len - 0.8 * u.u + 0.15 * (q.nu - p.nu - 2 * u.u)) u, a.rho ra, b.rho rb from u{k} u join r{k} a on a.node = u.src join r{k} b on b.node = u.dst join m{k} p on p.node = u.src join m{k} q on q.node = u.dst),
f{k} as (select node, sum(x) gain from (select src node, -(ra + rb) / 2 * u x from u{k + 1} union all select dst, (ra + rb) / 2 * u from u{k + 1}) group by node),
t{k} as (select node, greatest(rho + 0.01 * coalesce(gain, 0), 1e-12) rho, phi from r{k} left join f{k} using (node)),
r{k + 1} as (select node, rho / (select sum(rho) from t{k}) rho, phi from t{k})"""
    return sql + f" select node, round(rho, 8) rho from r{steps}"


@query(_fluid_sql(3))
def fluid_step(spark: SparkSession, root: str) -> DataFrame:
    """Three steps of the fluid on a ring of nations."""
    n = table(spark, root, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.lit(1 / 25).alias("rho"), (F.col("n_regionkey") / 5).alias("loss"), (F.col("n_nationkey") / 25).alias("cost"), F.lit(0.2).alias("info"))
    return rounded(graph.fluid(n, _ring(spark, root).select("src", "dst", F.lit(1.0).alias("length")), 3)[0], 8, "rho")


@query("""with a as (select distinct src, dst from (select least(sg_a, sg_b) src, greatest(sg_a, sg_b) dst from node_matches where matched and sg_a <> sg_b)), b as (select distinct src, dst from (select least(sg_a, sg_b) src, greatest(sg_a, sg_b) dst from node_matches where not matched and sg_a <> sg_b))
select case when a.src is not null and b.src is not null then 'shared' when a.src is not null then 'only_left' else 'only_right' end side, count(*) n from a full join b on a.src = b.src and a.dst = b.dst group by 1""")
def edge_audit(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "node_matches").select("matched", F.col("sg_a").alias("src"), F.col("sg_b").alias("dst"))
    return graph.audit(graph.canonical(m.where("matched")), graph.canonical(m.where("not matched")))


# ---- rasters, on a surface that both sides generate ----

def _surface(rows: str, cells: str) -> str:
    """The surface of valley_grid() with 36 columns and so many rows, from a table of cell numbers i."""
    return f"z as (select r, c, ({rows} - r) * 0.5::double + abs(c - 18) * 0.3::double + ((r * 7 + c * 13) % 11) * 0.01::double + (r * 36 + c) * 1e-6::double z from (select cast(i // 36 as int) r, cast(i % 36 as int) c from {cells}))"


_FLOWS = """,
o(d, dr, dc) as (values (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)),
f as (select a.r, a.c, o.d, (a.z - b.z) / case when dr <> 0 and dc <> 0 then sqrt(2.0) else 1.0 end s from z a, o join z b on b.r = a.r + o.dr and b.c = a.c + o.dc),
k as (select r, c, d from (select *, row_number() over (partition by r, c order by s desc, d) n from f where s > 0) where n = 1),
t as (select k.r, k.c, k.r + o.dr r2, k.c + o.dc c2 from k join o using (d)) """
#: A surface that grows with the tables, 40 rows for every hundred suppliers, and one of 40 rows.
_ROWS = "(select 40 * greatest(1, count(*) // 100) from supplier)"
_GRID = f"with recursive hh as (select {_ROWS} n), " + _surface("(select n from hh)", "(select unnest(range(36 * n)) i from hh)") + _FLOWS
_SMALL_GRID = "with recursive " + _surface("40", "range(1440) t(i)") + _FLOWS


def _valley(spark, root):
    suppliers = table(spark, root, "supplier").count()
    return raster.valley_grid(spark, 40 * max(1, suppliers // 100), 36)


@query(_GRID + """, g as (select r, c, z, lag(z) over x l, lead(z) over x h, lag(z) over y u, lead(z) over y d from z window x as (partition by r order by c), y as (partition by c order by r))
select 'valley' raster_id, r, c, round(sqrt(power(case when l is null then h - z when h is null then z - l else (h - l) / 2 end, 2) + power(case when u is null then d - z when d is null then z - u else (d - u) / 2 end, 2)), 7) slope from g""")
def raster_slope(spark: SparkSession, root: str) -> DataFrame:
    return rounded(raster.slope(_valley(spark, root)), 7, "slope")


@query(_GRID + "select 'valley' raster_id, z.r, z.c, round(z.z, 6) z, coalesce(k.d, -1) direction from z left join k on z.r = k.r and z.c = k.c")
def d8_direction(spark: SparkSession, root: str) -> DataFrame:
    return rounded(raster.flow_direction(_valley(spark, root)), 6, "z")


_ACC = ", up(r, c, r2, c2) as (select r, c, r, c from z union all select up.r, up.c, t.r2, t.c2 from up join t on up.r2 = t.r and up.c2 = t.c), acc as (select r2 r, c2 c, count(*) n from up group by all) "


@query(_GRID + _ACC + "select 'valley' raster_id, r, c, n accumulation from acc")
def flow_accumulation(spark: SparkSession, root: str) -> DataFrame:
    return raster.flow_accumulation(keep(raster.flow_direction(_valley(spark, root))))


@query(_GRID + _ACC + "select 'valley' raster_id, t.r, t.c, t.r2, t.c2 from t join acc a on a.r = t.r and a.c = t.c join acc b on b.r = t.r2 and b.c = t.c2 where a.n >= 12 and b.n >= 12")
def drainage_network(spark: SparkSession, root: str) -> DataFrame:
    d = keep(raster.flow_direction(_valley(spark, root)))
    return raster.drainage_edges(d, keep(raster.channels(raster.flow_accumulation(d), 12)))


@query(_GRID + _ACC + """, ch as (select r, c, row_number() over (order by n, r, c) k from acc where n >= 12),
feed as (select b.k, list(a.k) filter (a.k is not null) u from ch b left join (t join ch a on a.r = t.r and a.c = t.c) on t.r2 = b.r and t.c2 = b.c group by b.k),
s(k, o) as (select 0::bigint, []::int[] union all select feed.k, list_append(s.o, case when len(coalesce(u, [])) = 0 then 1 else list_max([s.o[x] for x in u]) + case when len([x for x in u if s.o[x] = list_max([s.o[y] for y in u])]) >= 2 then 1 else 0 end end) from s join feed on feed.k = s.k + 1)
select 'valley' raster_id, r, c, (select o from s order by k desc limit 1)[k] strahler from ch""")
def strahler_order(spark: SparkSession, root: str) -> DataFrame:
    """Stream order of the channels."""
    d = keep(raster.flow_direction(_valley(spark, root)))
    ch = keep(raster.channels(raster.flow_accumulation(d), 12))
    return raster.strahler(ch, raster.drainage_edges(d, ch))


# ---- choices under constraints ----


def _maxcal_sql(rounds: int) -> str:
    """Newton's steps on the dual unrolled: each takes mean and variance under the weights of the one before."""
    sql = "with o as (select o_orderkey, ln(o_totalprice) f from orders), g as (select avg(f) + 0.2 goal, avg(f) mid from o), l0 as (select 0.0::double l)"
    for k in range(rounds):
        sql += f", m{k} as (select sum(exp(-l * (f - mid)) * f) / sum(exp(-l * (f - mid))) m, sum(exp(-l * (f - mid)) * f * f) / sum(exp(-l * (f - mid))) s from o, g, l{k}), l{k + 1} as (select l + (m - goal) / (s - m * m) l from l{k}, m{k}, g)"
    return sql + f", e as (select o_orderkey, exp(-l * (f - mid)) w from o, g, l{rounds}) select o_orderkey, round(w / (select sum(w) from e), 11) p from e"


@query(_maxcal_sql(12))
def maxcal_fit(spark: SparkSession, root: str) -> DataFrame:
    """Least-biased weights of orders whose mean log price is above the plain mean."""
    o = table(spark, root, "orders").select("o_orderkey", F.ln("o_totalprice").alias("f"))
    target = o.agg(F.avg("f")).first()[0] + 0.2
    return rounded(maxcal.distribution(o, [F.col("f")], maxcal.fit(o, [F.col("f")], [target])).select("o_orderkey", "p"), 11, "p")


@query("""with s as (select s_suppkey, s_acctbal / 1000 - case when s_nationkey in (1, 2, 3) then 2 else 0 end score from supplier), t as (select *, row_number() over (order by s_suppkey) - 1 r, count(*) over () n from s where abs(score - (select max(score) from s)) <= 1e-6 * greatest(1, abs((select max(score) from s))))
select s_suppkey, round(score, 5) score from t where r = 7 % n""")
def best_candidate(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000 - F.when(F.col("s_nationkey").isin(1, 2, 3), 2.0).otherwise(0.0)).alias("score"))
    return rounded(maxcal.best_candidate(s, "s_suppkey", "score", 7), 5, "score")


@query("""with recursive n as (select tile_id, node_id, max(area) area, cast(min(sg_idx) as varchar) bucket from scene_nodes where area is not null and tile_id is not null and node_id is not null group by all),
o as (select *, 1.0 + area * 100 cost, row_number() over (partition by tile_id order by area desc, node_id) r from n),
s(tile_id, r, spent, used, kept, node_id, area, bucket, cost, taken) as (select tile_id, 0::bigint, 0.0::double, []::varchar[], 0, null::varchar, null::double, null::varchar, null::double, false from (select distinct tile_id from o) union all
select tile_id, r, case when ok then spent + cost else spent end, case when ok then list_append(used, coalesce(bucket, '<none>')) else used end, kept + case when ok then 1 else 0 end, node_id, area, bucket, cost, ok from (
 select o.*, s.spent, s.used, s.kept, s.kept < 5 and len([x for x in s.used if x = coalesce(o.bucket, '<none>')]) < 2 and s.spent + o.cost <= 10.0 ok from s join o on o.tile_id = s.tile_id and o.r = s.r + 1 where s.kept < 5))
select tile_id, node_id, area, bucket, cost from s where taken""")
def budgeted_pick(spark: SparkSession, root: str) -> DataFrame:
    """Greedy choice of nodes to ask about in each tile, under a budget."""
    n = table(spark, root, "scene_nodes").where("area is not null and tile_id is not null and node_id is not null").groupBy("tile_id", "node_id").agg(F.max("area").alias("area"), F.min("sg_idx").cast("string").alias("bucket"))
    return maxcal.budgeted_pick(n.withColumn("cost", 1.0 + F.col("area") * 100), "tile_id", "node_id", "area", "bucket", "cost", 2, 10.0, 5)
