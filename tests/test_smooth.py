import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions.columns import normal_quantile
from panelkit.operators import smooth


def series(spark, values, e="a"):
    return spark.createDataFrame([(e, i + 1, None if v is None else float(v)) for i, v in enumerate(values)], "e string, t int, y double")


@pytest.mark.parametrize("size", [16, 4096])
def test_moving_average_edges_and_nulls(spark, size):
    vals = list(range(1, 41)) + [None]
    out = smooth.moving_average(series(spark, vals), "e", "t", "y", {"m7": 7, "m30": 30}, size)
    got = {r.t: (r.m7, r.m30) for r in out.collect()}
    assert got[3][0] is None and got[4][0] == 4.0 and got[37][0] == 37.0 and got[38][0] is None
    # 30 rows: 14 behind, 15 ahead
    assert got[14][1] is None and got[15][1] == 15.5 and got[25][1] == 25.5 and got[26][1] is None


def test_moving_average_of_a_constant(spark):
    out = smooth.moving_average(series(spark, [3.0] * 20), "e", "t", "y", {"m": 7})
    assert {r.m for r in out.collect()} == {None, 3.0}


def naive_lowess(y, span=2 / 3, passes=3, delta=0.01):
    n = len(y)
    x = np.arange(1, n + 1, dtype=float)
    k = max(2, min(n, int(span * n + 1e-7)))
    step = max(1, int(delta * (n - 1)))
    anchors = sorted({min(n, 1 + i * step) for i in range(n)})
    rw = np.ones(n)
    for it in range(passes + 1):
        val = {}
        for c in anchors:
            d = np.abs(x - c)
            h = np.sort(d)[k - 1]
            w = np.where(d <= 0.999 * h, np.where(d <= 0.001 * h, 1, (1 - (d / h) ** 3) ** 3), 0) * rw
            w = w / w.sum()
            m = (w * x).sum()
            v = (w * (x - m) ** 2).sum()
            val[c] = (w * y).sum() + ((c - m) * (w * (x - m) * y).sum() / v if math.sqrt(v) > 0.001 * (n - 1) else 0)
        fit = np.interp(x, anchors, [val[c] for c in anchors])
        r = np.abs(y - fit)
        c6 = 6 * np.median(r)
        if it == passes or c6 < 1e-7 * r.mean():
            return fit
        rw = np.where(r <= 0.001 * c6, 1, np.where(r <= 0.999 * c6, (1 - (r / c6) ** 2) ** 2, 0))


def test_lowess_against_direct_computation(spark):
    rng = np.random.default_rng(3)
    short = np.sin(np.arange(41) / 6) + rng.normal(0, 0.2, 41)
    short[7] += 9
    long = np.cos(np.arange(430) / 50) + rng.normal(0, 0.2, 430)  # anchors four rows apart
    df = series(spark, short, "s").unionByName(series(spark, long, "l"))
    out = smooth.lowess(df, "e", "t", "y", size=64)
    for e, y in (("s", short), ("l", long)):
        got = [r.trend for r in out.filter(F.col("e") == e).orderBy("pos").collect()]
        assert np.allclose(got, naive_lowess(y), atol=1e-9)


def test_lowess_reproduces_a_line(spark):
    out = smooth.lowess(series(spark, [2 * i + 1 for i in range(30)]), "e", "t", "y")
    assert max(abs(r.trend - r.y) for r in out.collect()) < 1e-9


def test_kernel_smooth_against_direct_sums(spark):
    rng = np.random.default_rng(1)
    x, y = np.round(rng.uniform(0, 20, 130), 1), rng.normal(0, 1, 130)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = smooth.kernel_smooth(df, "x", "y", 3.0).orderBy("point").collect()
    sd = 0.25 * 3 / 0.6744897501960817
    assert len(got) == 130 and got[0].x0 == x.min() and got[-1].x0 == pytest.approx(x.max())
    for r in got:
        d = np.abs(x - r.x0)
        w = np.where(d <= 4 * sd, np.exp(-0.5 * (d / sd) ** 2), 0)
        assert r.y_hat == pytest.approx((w * y).sum() / w.sum(), abs=1e-12)


def test_kernel_smooth_gap_is_null(spark):
    df = spark.createDataFrame([(0.0, 1.0), (100.0, 2.0)], "x double, y double")
    got = [r.y_hat for r in smooth.kernel_smooth(df, "x", "y", 1.0).orderBy("point").collect()]
    assert got[0] == 1.0 and got[-1] == 2.0 and got[50] is None


def test_normal_quantile(spark):
    ps = [0.001, 0.02, 0.3, 0.5, 0.975, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select(normal_quantile(F.col("p")))
    want = [-3.090232306, -2.053748911, -0.524400513, 0.0, 1.959963985, 3.090232306]
    assert [r[0] for r in df.collect()] == pytest.approx(want, abs=1e-7)


def test_qq_points_are_sorted_and_centred(spark):
    df = spark.range(101).select(F.col("id"), ((F.col("id") * 37) % 101).cast("double").alias("v"))
    out = smooth.qq_points(df, "v", ["id"]).orderBy("rank").collect()
    assert [r.v for r in out] == sorted(r.v for r in out)
    assert out[50].theoretical == pytest.approx(0, abs=1e-9)
    assert out[0].theoretical == pytest.approx(-out[-1].theoretical, abs=1e-9)


def cubic(x):
    return 0.3 * x**3 - 4 * x**2 + x - 2


def test_spline_reproduces_a_cubic_and_hits_knots(spark):
    months = {m: cubic(m + 0.5) for m in range(1, 12) if m != 8}
    out = smooth.month_effect_spline(spark, months, 8).orderBy("day").collect()
    assert len(out) == 31 and [r.day for r in out] == list(range(1, 32))
    assert all(8 < r.x0 < 9 and r.effect == pytest.approx(cubic(r.x0), abs=1e-10) for r in out)
    rng = np.random.default_rng(0)
    x, y = np.arange(10.0), rng.normal(size=10)
    c = smooth.spline_coefficients(x, y)
    grid = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = [r[0] for r in grid.select(smooth.spline_value(F.col("x"), c)).collect()]
    assert got == pytest.approx(list(y), abs=1e-12)
