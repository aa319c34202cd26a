"""Fits by QR: many, nearly collinear and dependent columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.models import gram, linear


def table(spark, x, y, e):
    k = x.shape[1]
    names = [f"x{i}" for i in range(k)]
    rows = [(int(a), *map(float, r), float(v)) for a, r, v in zip(e, x, y, strict=True)]
    return spark.createDataFrame(rows, "e int, " + ", ".join(f"{n} double" for n in names) + ", y double").repartition(40), names


def demeaned(a, e):
    out = a.astype(float).copy()
    for i in np.unique(e):
        out[e == i] -= out[e == i].mean(0)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    n = 3000
    x = rng.normal(size=(n, 24)) * 10.0 ** rng.integers(-3, 4, 24) + 50
    e = rng.integers(0, 60, n)
    y = x @ (rng.normal(size=24) / x.std(0)) + e / 10 + rng.normal(size=n)
    return x, y, e


def test_24_columns(spark, rows):
    x, y, e = rows
    df, names = table(spark, x, y, e)
    fit = linear.within(df, "y", names, "e")
    xd, yd = demeaned(x, e), demeaned(y, e)
    want = np.linalg.lstsq(xd, yd, rcond=None)[0]
    assert np.allclose(fit.beta, want, rtol=1e-8) and fit.dropped == []
    r = np.linalg.qr(xd, mode="r")
    assert np.allclose(fit.bread, np.linalg.inv(r) @ np.linalg.inv(r).T, rtol=1e-7)
    assert np.isclose(fit.rss, ((yd - xd @ want) ** 2).sum(), rtol=1e-9)
    pooled = linear.ols_pooled(df, "y", names)
    full = np.column_stack([np.ones(len(y)), x])
    assert np.allclose(pooled.beta, np.linalg.lstsq(full, y, rcond=None)[0], rtol=1e-8)
    assert pooled.n == len(y) and np.isclose(pooled.tss, ((y - y.mean()) ** 2).sum(), rtol=1e-9)


def test_both_ways_agree(spark, rows):
    x, y, e = rows
    df, names = table(spark, x[:, :4], y, e)
    for fit in (linear.within, lambda *a, **b: linear.ols_pooled(*a[:3], **b)):
        a, b = fit(df, "y", names, "e", qr=True), fit(df, "y", names, "e", qr=False)
        for f in ("beta", "vcov", "rss", "tss", "sigma2", "n", "df_resid"):
            assert np.allclose(getattr(a, f), getattr(b, f), rtol=1e-8), f


@pytest.mark.parametrize("gap", [1e-4, 1e-6])
def test_nearly_collinear_columns(spark, gap):
    """Integers times powers of two, so that columns and their means are exact and only the method can lose digits."""
    rng = np.random.default_rng(9)
    n, unit = 2048, 2.0 ** np.floor(np.log2(gap))
    e = np.repeat(np.arange(32), 64)
    a, b = rng.integers(-500, 500, n).astype(float), rng.integers(-500, 500, n).astype(float)
    x = np.column_stack([a, a + unit * b, rng.integers(-9, 9, n)])
    y = a + 3 * unit * b + rng.integers(-3, 4, n) * unit
    df, names = table(spark, x, y, e)
    fit = linear.within(df, "y", names, "e")
    # the same fit on a, b: an exact change of coordinates
    z = demeaned(np.column_stack([a, b, x[:, 2]]), e)
    c = np.linalg.lstsq(z, demeaned(y, e), rcond=None)[0]
    want = [c[0] - c[1] / unit, c[1] / unit, c[2]]
    assert fit.dropped == [] and np.allclose(fit.beta[:2], want[:2], rtol=1e-8)


def test_dependent_columns_are_named(spark, rows):
    x, y, e = rows
    x = np.column_stack([x[:, 0], 2 * x[:, 0] - 1, x[:, 1], e * 1.0, x[:, 0] - x[:, 1]])
    df, names = table(spark, x, y, e)
    fit = linear.within(df, "y", names, "e", ["x2"])
    assert fit.xs == ["x0", "x2"] and fit.dropped == ["x1", "x3", "x4"]
    assert np.allclose(fit.beta, np.linalg.lstsq(demeaned(x[:, [0, 2]], e), demeaned(y, e), rcond=None)[0], rtol=1e-8)
    scored = fit.scored().agg(F.sum(F.col("resid") ** 2)).first()[0]
    assert np.isclose(scored, fit.rss, rtol=1e-8)
    assert linear.ols_pooled(df, "y", names).dropped == ["x1", "x4"]
    with pytest.raises(np.linalg.LinAlgError):
        linear.within(df, "y", ["x3"], "e")


def test_triangle_merges_levels(spark, rows, monkeypatch):
    x, y, e = rows
    df, names = table(spark, x[:, :3], y, e)
    monkeypatch.setattr(gram, "MERGED", 3)
    r = gram.triangle(df, [F.col(n) for n in names])
    assert np.allclose(r.T @ r, x[:, :3].T @ x[:, :3], rtol=1e-10)
