"""Moving windows and runs against plain numpy restatements."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import climbs, metrics, runs, windows


def ride(spark, d, e, p=None, key=1):
    p = np.zeros(len(d)) if p is None else p
    return spark.createDataFrame([(key, i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(d, e, p))], "ride long, seq long, d double, e double, p double")


def column(df, name):
    return [r[name] for r in df.orderBy("seq").collect()]


def test_rolling_peak(spark):
    p = np.random.default_rng(3).integers(0, 400, 90)
    got = {r["window"]: r.peak for r in windows.rolling_peak(ride(spark, p, p, p), "p", [1, 5, 30, 90, 91, 0]).collect()}
    for w in (1, 5, 30, 90):
        assert got[w] == pytest.approx(np.convolve(p, np.ones(w) / w, "valid").max())
    assert got[91] is None and 0 not in got
    assert windows.rolling_peak(ride(spark, p, p, p), "p", [91], missing="omit").count() == 0


def test_normalized_power(spark):
    const = ride(spark, range(120), range(120), np.full(120, 200.0))
    short = ride(spark, range(10), range(10), np.full(10, 150.0))
    assert metrics.normalized_power(const).first().np_w == pytest.approx(200)
    assert metrics.normalized_power(short).first().np_w == pytest.approx(150)


def test_median_takes_a_spike_out(spark):
    assert column(windows.median_filter(ride(spark, range(5), [10, 10, 99, 10, 10]), "e", 3, "m"), "m")[2] == 10


def test_smoothing_modes(spark):
    e = np.random.default_rng(5).normal(100, 5, 40)
    r = ride(spark, range(40), e)
    assert np.allclose(column(windows.smooth(r, "e", 9, "s"), "s"), np.convolve(e, np.ones(9) / 9, "same"))
    assert np.allclose(column(windows.smooth(r, "e", 4, "s"), "s"), np.convolve(e, np.ones(4) / 4, "same"))
    assert np.allclose(column(windows.smooth(r, "e", 11, "s", mode="edge"), "s"), np.convolve(np.pad(e, 5, "edge"), np.ones(11) / 11, "valid"))


def test_gaps(spark):
    e = [np.nan, 1, np.nan, np.nan, 4, np.nan]
    assert column(windows.interpolate_gaps(ride(spark, range(6), e), "e", "v"), "v") == pytest.approx([1, 1, 2, 3, 4, 4])
    assert column(windows.interpolate_gaps(ride(spark, range(2), [np.nan] * 2), "e", "v"), "v") == [0, 0]


def test_grid_is_linear_interpolation(spark):
    d = np.cumsum(np.random.default_rng(9).integers(3, 9, 60)).astype(float)
    e = np.sin(d)
    got = windows.onto_grid(ride(spark, d, e), "d", ["e"], 10.0).orderBy("k").collect()
    grid = np.arange(d[0], d[-1], 10.0)
    assert np.allclose([r.x for r in got], grid) and np.allclose([r.e for r in got], np.interp(grid, d, e))


def test_span_grade(spark):
    d = np.cumsum(np.random.default_rng(1).integers(1, 12, 80)).astype(float)
    e = np.random.default_rng(2).normal(0, 2, 80)
    want = []
    for i in range(80):
        j = k = i
        while j > 0 and d[i] - d[j] < 30:
            j -= 1
        while k < 79 and d[k] - d[i] < 30:
            k += 1
        want.append(0 if d[k] - d[j] < 5 else 100 * (e[k] - e[j]) / (d[k] - d[j]))
    assert np.allclose(column(windows.span_grade(ride(spark, d, e), "d", "e", 30.0, "g"), "g"), want)


def test_longest_run_and_walls(spark):
    g = spark.createDataFrame([(1, i, 10.0 * i, float(x)) for i, x in enumerate([5, 9, 11, 13, 12, 8, 7])], "ride long, seq long, d double, g double")
    got = {r.threshold: r.metres for r in runs.longest_run_above(g, "g", "d", (10.0, 12.0, 20.0)).collect()}
    assert got == {10.0: 30.0, 12.0: 20.0, 20.0: 0.0}
    w = spark.createDataFrame([(1, i, float(i), 12.0 if 200 <= i < 250 else 5.0) for i in range(451)], "ride long, seq long, d double, g double")
    (wall,) = runs.walls(w, "g", "d").collect()
    assert (wall.offset_m, wall.length_m, round(wall.pct_in)) == (200, 49, 44)


def test_mean_max(spark):
    d = np.arange(0, 1001, 5.0)
    got = {r.window_m: r.grade for r in windows.mean_max_grade(ride(spark, d, 0.08 * d), "d", "e", [25, 500, 2000]).collect()}
    assert got[25] == pytest.approx(8) and got[500] == pytest.approx(8) and got[2000] is None


def test_one_climb_on_a_ramp(spark):
    d = np.arange(0, 8001, 5.0)
    e = np.clip(d - 3000, 0, 1500) * 0.07 + 0.2 * np.sin(d / 50) + 50
    (c,) = [r for r in climbs.find_climbs(ride(spark, d, e), mode="truncated").collect() if r.gain_m > 50]
    assert 2.5 <= c.start_km <= 3.5 and 6 <= c.avg_grade_pct <= 8
    assert climbs.find_climbs(ride(spark, d, d * 0)).count() == 0
    assert climbs.find_climbs(ride(spark, d[:20], d[:20])).count() == 0


def test_surge(spark):
    p = np.full(300, 150.0)
    p[100:160] = 400
    r = ride(spark, np.arange(300) * 10.0, np.zeros(300), p)
    (a,) = runs.flat_attacks(r, 250).collect()
    assert (a.samples, a.peak_w) == (60, 400)
    assert runs.flat_attacks(r, 0).count() == 0
    assert runs.flat_attacks(r.withColumn("e", F.lit(None).cast("double")), 250).count() in (0, 1)
