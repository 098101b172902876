import numpy as np
from pyspark.sql import functions as F

from weft.operators.grid import COLUMNS, common_course, complete, factorise, local_levels, regular_grid

SCHEMA = "source string, interval int, reading_id long, micros long, x double, k string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_periods_and_states(spark):
    s = 1_000_000
    rows = [("a", 10, 1, 100 * s, 1.0), ("a", 10, 1, 100 * s, 1.0), ("a", 10, 2, 109 * s + 999_999, 3.0), ("a", 10, 3, 130 * s, 5.0), ("a", 10, 4, 110 * s, None), ("a", 10, 5, 120 * s, float("nan")), ("a", 10, 6, None, 4.0), (None, 10, 7, 100 * s, 4.0), ("b", None, 8, 100 * s, 4.0), ("c", 0, 9, 100 * s, 4.0), ("d", 5, 10, 7 * s, 2.0)]
    got = {(r.source, r.period_start): (r.value, r.state) for r in regular_grid(rows_of(spark, rows)).collect()}
    assert got == {("a", 100): (2.0, "observed"), ("a", 110): (None, "unsupported"), ("a", 120): (None, "unsupported"), ("a", 130): (5.0, "observed"), ("d", 5): (2.0, "observed")}


def test_filling_a_low_rank_matrix(spark):
    rnd = np.random.default_rng(0)
    shape, level = np.sin(np.arange(90) / 7), rnd.normal(size=30) * 5 + 50
    gain = rnd.normal(size=30)
    rows, hidden = [], {}
    for i in range(30):
        for t in range(90):
            x = level[i] + gain[i] * shape[t]
            if t in (0, 89) or rnd.random() > 0.3:
                rows.append((f"s{i}", 2, i * 1000 + t, (1000 * i + t) * 2_000_000, float(x)))
            else:
                hidden[f"s{i}", (1000 * i + t) * 2] = x
    got = regular_grid(rows_of(spark, rows)).where("state <> 'observed'").collect()
    assert {(r.source, r.period_start) for r in got} == set(hidden)
    error = np.array([r.value - hidden[r.source, r.period_start] for r in got if r.state == "filled"])
    assert len(error) > 0.95 * len(hidden) and np.sqrt((error**2).mean()) < 0.25 * np.std(list(gain)[0] * shape) + 0.1


def test_observed_cells_are_exact(spark):
    rows = [("a", 1, i, i * 3_000_000, 0.1 * i) for i in range(50)]
    got = regular_grid(rows_of(spark, rows)).where("state = 'observed'").collect()
    assert {r.period_start: r.value for r in got} == {3 * i: 0.1 * i for i in range(50)}


def test_long_gap_over_many_blocks(spark):
    n = 5 * COLUMNS
    got = regular_grid(rows_of(spark, [("a", 1, 1, 0, 1.0), ("a", 1, 2, n * 1_000_000, 2.0)])).groupBy("state").count().collect()
    assert {r.state: r["count"] for r in got} == {"observed": 2, "unsupported": n - 1}


def test_factorise_is_deterministic_and_keeps_constants():
    v, seen = np.full((4, 5), 3.0), np.eye(4, 5) == 0
    assert np.allclose(factorise(v, seen), 3.0)
    assert factorise(np.zeros((2, 3)), np.zeros((2, 3), bool)).shape == (2, 3)


def test_empty(spark):
    assert regular_grid(rows_of(spark, [])).where(F.lit(True)).count() == 0


def test_readings_without_an_id_count_each(spark):
    s = 1_000_000
    rows = [("a", 10, None, 100 * s, 1.0), ("a", 10, None, 101 * s, 3.0), ("a", 10, None, 101 * s, 3.0), ("a", 10, 7, 102 * s, 9.0), ("a", 10, 7, 102 * s, 9.0)]
    [r] = regular_grid(rows_of(spark, rows)).collect()
    assert (r.period_start, r.value, r.state) == (100, 4.0, "observed")


def test_stamps_before_1970(spark):
    rows = [("a", 1, i, i * 1_000_000, float(i)) for i in range(-10, 0)] + [("a", 1, 5, 4_000_000, 4.0)]
    got = regular_grid(rows_of(spark, rows)).collect()
    assert sorted(r.period_start for r in got) == list(range(-10, 5))
    assert {r.period_start for r in got if r.state != "observed"} == {0, 1, 2, 3}


def test_sources_of_one_clock_fill_each_other(spark):
    rnd = np.random.default_rng(3)
    shape = rnd.normal(size=200).cumsum()
    rows, hidden = [], {}
    for i in range(40):
        gap = set(range(5 + i * 17 % 130, 65 + i * 17 % 130))  # far longer than the reach of the row's own cells
        for t in range(200):
            x = 100 + (1 + i / 40) * shape[t]
            if t in gap:
                hidden[f"s{i:02d}", t * 5] = x
            else:
                rows.append((f"s{i:02d}", 5, i * 1000 + t, t * 5_000_000, float(x)))
    got = regular_grid(rows_of(spark, rows)).where("state = 'filled'").collect()
    assert len(got) > 0.9 * len(hidden)
    error = np.array([r.value - hidden[r.source, r.period_start] for r in got])
    level = {f"s{i:02d}": np.mean([x for s, _, _, _, x in rows if s == f"s{i:02d}"]) for i in range(40)}
    plain = np.array([level[r.source] - hidden[r.source, r.period_start] for r in got])
    assert np.sqrt((error**2).mean()) < 0.5 * np.sqrt((plain**2).mean())


def test_where_the_clock_is_cut_does_not_matter(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=3 * COLUMNS).cumsum()
    kept = [t for t in range(len(x)) if t in (0, len(x) - 1) or rnd.random() > 0.3]
    out = []
    for shift in (0, 100 * 1_000_000):
        got = regular_grid(rows_of(spark, [("a", 1, t, t * 1_000_000 + shift, float(x[t])) for t in kept])).collect()
        out.append({r.period_start - shift // 1_000_000: (r.state, r.value) for r in got})
    assert out[0] == out[1] and {s for s, _ in out[0].values()} == {"observed", "filled"}


def test_many_sources_are_cut_by_level(spark):
    rows = [(f"s{i}", 1, i * 100 + t, t * 1_000_000, float(i + t % 3)) for i in range(60) for t in range(40) if t % 7 or t in (0, 39)]
    whole = {(r.source, r.period_start, r.state) for r in regular_grid(rows_of(spark, rows)).collect()}
    cut = {(r.source, r.period_start, r.state) for r in regular_grid(rows_of(spark, rows), rows=5).collect()}
    assert whole == cut and len(whole) == 60 * 40


def test_local_levels():
    v, seen = np.array([[1.0, 2, 3, 100, 5, 0, 0]]), np.array([[True, True, True, True, True, False, False]])
    level, count = local_levels(v, seen, reach=2, nearest=2)
    assert level[0].tolist()[:6] == [2.5, 3.0, 3.5, 3.0, 51.5, 52.5] and level[0, 6] == 5.0
    assert count[0].tolist() == [2, 3, 4, 3, 2, 2, 1]
    fit, enough = complete(v, seen)
    assert enough.all() and fit[0, 6] == 3.0


def test_sources_without_a_common_course_get_nothing_from_each_other():
    rnd = np.random.default_rng(5)
    seen = rnd.random((6, 250)) > 0.2
    noise = rnd.normal(size=seen.shape)
    assert np.abs(common_course(noise, seen)).mean() < 0.1
    shape, gain = rnd.normal(size=250), rnd.normal(size=6) + 2
    rest = gain[:, None] * shape + 0.1 * noise
    off = (common_course(rest, seen) - rest)[~seen]
    assert np.sqrt((off**2).mean()) < 0.4 * rest.std()
