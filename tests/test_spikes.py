import numpy as np
import pytest

from weft.operators.grouped import chunked
from weft.operators.spikes import flag_spikes, judge, run_lengths, usual_of_sources, usual_scatter

SCHEMA = "src string, field string, source string, row_id long, at double, x double, low double, high double, zeros_rest boolean, key string"
NAN = float("nan")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def series(n=300, level=100.0, scatter=1.0, seed=0):
    return np.random.default_rng(seed).normal(level, scatter, n)


@pytest.mark.parametrize("length", [1, 2, 3])
@pytest.mark.parametrize("height", [15, -15, 200])
def test_excursions(length, height):
    x = series()
    x[100 : 100 + length] += height
    assert set(np.flatnonzero(judge(x, NAN, NAN, False) == 3)) == set(range(100, 100 + length))


def test_longer_excursions_and_changes_of_level_are_normal():
    x = series()
    x[100:104] += 50
    x[200:] -= 40
    assert not judge(x, NAN, NAN, False).any()


def test_small_deviations_are_normal():
    x = series()
    x[50] = 106
    assert not judge(x, NAN, NAN, False).any()


def test_a_ramp_is_normal_but_a_spike_in_it_is_not():
    x = np.concatenate([np.zeros(60), np.arange(40) * 0.08, np.full(100, 3.2), 3.2 - np.arange(40) * 0.08]) + np.random.default_rng(1).normal(0, 0.01, 240)
    assert not judge(x, NAN, NAN, False).any()
    x[80] += 2
    assert set(np.flatnonzero(judge(x, NAN, NAN, False))) == {80}


@pytest.mark.parametrize("length", [1, 2, 3])
@pytest.mark.parametrize("slope", [0.5, 1.0, 2.0, 5.0, -1.0])
@pytest.mark.parametrize("depth", [12, 14, -12])
def test_excursions_on_a_slope_are_found_wherever_the_chart_lags(slope, depth, length):
    for seed in range(20):
        x = series(seed=seed) + slope * np.arange(300)
        around = x[149], x[150 + length]
        x[150 : 150 + length] = min(around) - depth if depth > 0 else max(around) - depth
        assert set(np.flatnonzero(judge(x, NAN, NAN, False) == 3)) == set(range(150, 150 + length))


def test_turns_of_steep_ramps_and_readings_between_excursions_are_normal():
    x = series()
    x[100:109] += 20.0 * (4 - np.abs(np.arange(-4, 5)))
    assert not judge(x, NAN, NAN, False).any()
    x = series() + np.arange(300)
    x[150] = x[152] = 30.0 + x[151]
    assert set(np.flatnonzero(judge(x, NAN, NAN, False))) == {150, 152}


def test_stuck_and_limits():
    x = series()
    x[20:35] = 101.0
    x[60:74] = 99.0
    x[90], x[91] = -1.0, 500.0
    reason = judge(x, 0.0, 400.0, False)
    assert set(np.flatnonzero(reason == 2)) == set(range(20, 35))
    assert set(np.flatnonzero(reason == 1)) == {90, 91}
    assert set(np.flatnonzero(reason)) == set(range(20, 35)) | {90, 91}


def test_zeros_may_rest():
    x = np.concatenate([series(50, 1, 0.01), np.zeros(30), series(50, 1, 0.01, 1)])
    assert not judge(x, NAN, NAN, True).any()
    assert (judge(x, NAN, NAN, False)[50:80] == 2).all()


def test_run_lengths():
    assert run_lengths(np.array([1.0, 1, 2, 3, 3, 3])).tolist() == [2, 2, 1, 3, 3, 3]


@pytest.mark.parametrize("x", [[], [5.0], [5.0, 5.0], [1.0, 900.0, 1.0], [2.0] * 14])
def test_short_series(x):
    assert not judge(np.array(x), NAN, NAN, False).any()


def test_coarse_readings():
    x = np.round(series(400, 50, 0.2))
    x[200] += 30
    assert set(np.flatnonzero(judge(x, NAN, NAN, False) == 3)) == {200}


def test_table(spark):
    x = series(120)
    x[60] = 300
    rows = [("t", "f", "a", i, float(i), float(v), None, None, False) for i, v in enumerate(x)]
    rows += rows[55:65] + [("t", "f", "a", 900, 59.5, NAN, None, None, False), ("t", "f", "a", 901, None, 3.0, None, None, False), ("t", "f", None, 902, 1.0, 3.0, None, None, False), ("t", "f", "a", None, 1.0, 3.0, None, None, False), ("t", "f", "a", 903, 1.0, None, None, None, False), ("t", "f", "b", 904, 1.0, 9.0, None, 5.0, False)]
    got = {tuple(r) for r in flag_spikes(frame(spark, rows)).collect()}
    assert got == {("t", 60, "f", "excursion"), ("t", 904, "f", "range")}


def test_empty_table(spark):
    assert flag_spikes(frame(spark, [])).count() == 0


def test_a_hot_source_in_chunks_is_judged_alike(spark):
    x = series(20_000, seed=3)
    rnd = np.random.default_rng(7)
    for i in rnd.choice(np.arange(10, 19_990), 120, replace=False):
        x[i] += rnd.choice([-1, 1]) * 40
    for i in rnd.choice(19_000, 15, replace=False):
        x[i : i + rnd.integers(15, 60)] = x[i]
    rows = [("t", "f", "hot", i, float(i), float(v), 0.0, 130.0, False) for i, v in enumerate(x)]
    rows += [("t", "f", f"s{k}", 10**6 + k * 100 + i, float(i), float(v), 0.0, 130.0, False) for k in range(3) for i, v in enumerate(x[:90])]
    df = frame(spark, rows).cache()
    whole = {tuple(r) for r in flag_spikes(df).collect()}
    cut = flag_spikes(df, source_rows=2_000)
    assert {tuple(r) for r in cut.collect()} == whole and cut.count() == len(whole) > 200


def test_a_hot_source_whose_scatter_changes_is_judged_by_all_of_it(spark):
    x = np.concatenate([series(15_000, seed=4), series(5_000, scatter=4.0, seed=5)])
    for i in range(15_100, 19_900, 200):
        x[i] = max(x[i - 1], x[i + 1]) + 25
    rows = [("t", "f", "hot", i, float(i), float(v), None, None, False) for i, v in enumerate(x)]
    df = frame(spark, rows).cache()
    whole = {tuple(r) for r in flag_spikes(df).collect()}
    assert {tuple(r) for r in flag_spikes(df, source_rows=2_000).collect()} == whole
    assert {r[1] for r in whole} >= set(range(15_100, 19_900, 200))


def test_usual_scatter_of_chunks_is_that_of_the_source(spark):
    for x in (np.concatenate([series(9_000, seed=6), series(3_000, scatter=4.0, seed=7)]), np.round(series(8_000, 50, 0.2)), np.full(5_000, 7.0)):
        rows = spark.createDataFrame([("s", f"s{i // 1000}", i, float(i), float(v), NAN, NAN, True) for i, v in enumerate(x)], "source string, key string, row_id long, at double, x double, low double, high double, core boolean")
        margin = rows.selectExpr("source", "concat('s', cast(substr(key, 2) as int) + 1) key", "row_id", "at", "x", "low", "high", "false core").where("row_id % 1000 >= 900")
        got = usual_of_sources(rows.unionByName(margin)).collect()
        assert len(got) == 1
        assert (got[0].scatter, got[0].step) == pytest.approx(usual_scatter(x, run_lengths(x), np.ones(len(x), bool)), rel=2e-3)


def test_chunks_cover_every_row_once(spark):
    df = spark.range(5_000).selectExpr("'k' as key", "cast(id as double) as at", "id as row_id")
    cut = chunked(df, "key", ["at"], 500)
    assert cut.where("core").count() == 5_000 and cut.where("core").select("chunk").distinct().count() > 5
    sizes = [r["count"] for r in cut.groupBy("chunk").count().collect()]
    assert max(sizes) < 2_000


def test_chunks_follow_the_size_and_cut_ties(spark):
    df = spark.range(40_000).selectExpr("if(id < 39000, 'k', 'small') as key", "cast(if(id < 20000, 7, id) as double) as at", "id as row_id")
    cut = chunked(df, "key", ["at", "row_id"], 100)
    assert cut.where("core").count() == 40_000
    sizes = cut.where("key = 'k'").groupBy("chunk").count().collect()
    assert len(sizes) > 400 and max(r["count"] for r in sizes) <= 110


@pytest.mark.parametrize("x", [[5.0] * 5 + [50.0] + [5.0] * 4, [5.0] * 30 + [50.0, 51.0] + [5.0] * 13])
def test_a_spike_cannot_hide_itself_in_a_constant_source(x):
    assert (np.array(x)[judge(np.array(x), NAN, NAN, False) == 3] >= 50).sum() == sum(v >= 50 for v in x) == (judge(np.array(x), NAN, NAN, False) == 3).sum()


def test_a_coarse_instrument_may_flicker():
    x = np.full(200, 5.0)
    x[10::29] = 6.0
    assert not (judge(x, NAN, NAN, False) == 3).any()
    x[100] = 40.0
    assert set(np.flatnonzero(judge(x, NAN, NAN, False) == 3)) == {100}


@pytest.mark.parametrize("bound", [500, 5_000])
def test_any_bound_gives_the_same_flags(spark, bound):
    rnd = np.random.default_rng(11)
    x = np.concatenate([series(6_000, seed=8), np.round(series(6_000, scatter=5.0, seed=9)), np.full(200, 80.0), series(2_000, scatter=0.3, seed=10)])
    at = np.floor(np.arange(len(x)) / 3)  # ties, which go by row_id
    for i in rnd.choice(len(x) - 20, 150, replace=False):
        x[i] += rnd.choice([-1, 1]) * rnd.uniform(20, 90)
    rows = [("t", "f", "hot", i, float(at[i]), float(v), None, None, False) for i, v in enumerate(x)]
    rows += [rows[i] for i in rnd.choice(len(rows), 2_000)]
    rows += [("t", "f", f"s{k}", 10**6 + k * 200 + i, float(i), float(v), None, None, False) for k in range(3) for i, v in enumerate(x[:140])]
    df = frame(spark, rows).cache()
    whole, cut = (sorted(tuple(r) for r in flag_spikes(df, source_rows=b).collect()) for b in (10**6, bound))
    assert cut == whole and len(whole) == len(set(whole)) > 100
