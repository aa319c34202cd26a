"""General feasible GLS against plain numpy, in one tile and in many."""

import numpy as np
import pytest

from panelkit.models import fgls, linear


def factor_inverse(a, floor):
    """Generalised inverse by elimination: times whose pivot is not above the floor are left out."""
    keep = []
    for j in range(len(a)):
        s = a[np.ix_(keep, keep)]
        pivot = a[j, j] - (a[j, keep] @ np.linalg.solve(s, a[keep, j]) if keep else 0.0)
        if pivot > floor:
            keep.append(j)
    out = np.zeros_like(a)
    out[np.ix_(keep, keep)] = np.linalg.inv(a[np.ix_(keep, keep)])
    return out


def plain(e, t, x, y):
    """The same estimate with one T x T covariance and one inverse per entity."""
    xd, yd = x.copy(), y.copy()
    for i in np.unique(e):
        xd[e == i] -= xd[e == i].mean(0)
        yd[e == i] -= yd[e == i].mean()
    u = yd - xd @ np.linalg.lstsq(xd, yd, rcond=None)[0]
    size = t.max() + 1
    num, cnt = np.zeros((size, size)), np.zeros((size, size))
    for i in np.unique(e):
        at = t[e == i]
        num[np.ix_(at, at)] += np.outer(u[e == i], u[e == i])
        cnt[np.ix_(at, at)] += 1
    omega = num / np.maximum(cnt, 1)
    a, b = 0, 0
    for i in np.unique(e):
        at = t[e == i]
        w = factor_inverse(omega[np.ix_(at, at)], fgls.PIVOT * omega.diagonal().max())
        a, b = a + xd[e == i].T @ w @ xd[e == i], b + xd[e == i].T @ w @ yd[e == i]
    return np.linalg.solve(a, b), np.linalg.inv(a)


def panel(spark, entities, times, missing, seed=4):
    rng = np.random.default_rng(seed)
    e, t = (a.ravel() for a in np.meshgrid(np.arange(entities), np.arange(times), indexing="ij"))
    keep = rng.random(len(e)) >= missing * (e % 3 == 0)
    e, t = e[keep], t[keep]
    x = np.column_stack([rng.normal(size=len(e)), 5 + np.sin(t) * rng.random(len(e))])
    noise = np.array([rng.normal(size=times).cumsum() * 0.3 for _ in range(entities)])[e, t]
    y = x @ [0.5, -1.0] + 3 * rng.normal(size=entities)[e] + noise
    rows = [(int(a), int(b) + 7, float(c), float(d), float(f)) for a, b, (c, d), f in zip(e, t, x, y, strict=True)]
    return spark.createDataFrame(rows, "e int, t int, x1 double, x2 double, y double"), (e, t, x, y)


@pytest.mark.parametrize(("tile", "missing"), [(256, 0.0), (4, 0.0), (4, 0.3), (3, 0.9)])
def test_tiles_give_the_plain_estimate(spark, tile, missing):
    df, plain_rows = panel(spark, 40, 10, missing)
    fit = fgls.fgls_within(df, "y", ["x1", "x2"], "e", "t", tile=tile)
    beta, cov = plain(*plain_rows)
    assert np.allclose(fit.beta, beta, rtol=1e-7) and np.allclose(fit.vcov, cov, rtol=1e-6)
    assert fit.scored().count() == len(plain_rows[0])


def test_identity_covariance_is_within(spark):
    df, _ = panel(spark, 12, 9, 0.2)
    first = linear.within(df, "y", ["x1", "x2"], "e", ["t"])
    rows, tiles = fgls.entity_rows(first, "t", 4)
    eye = [(i, j, np.eye(4).ravel().tolist() if i == j else [0.0] * 16) for i in range(tiles) for j in range(i + 1)]
    m = fgls.gls_products(rows, spark.createDataFrame(eye, "i int, j int, v array<double>"), tiles, 4, 3)
    assert np.allclose(np.linalg.solve(m[:2, :2], m[:2, 2]), first.beta, atol=1e-9)


def test_long_panel_in_tiles(spark):
    """2000 times: no array of the code is larger than a tile, a row of an entity, or a group of those."""
    n, times = 12, 2000
    df = spark.range(n * times).selectExpr("cast(id % 12 as int) e", "cast(id div 12 as int) t")
    df = df.selectExpr("e", "t", "sin(e * 7 + t * 0.37) x1", "cos(t * 0.11 * (e + 1)) x2", "(hash(e, t) % 1000) / 1000.0 noise")
    df = df.selectExpr("e", "t", "x1", "x2", "2 * x1 - x2 + e + noise as y")
    fit = fgls.fgls_within(df, "y", ["x1", "x2"], "e", "t", tile=256)
    assert np.isfinite(fit.beta).all() and abs(fit.beta[0] - 2) < 0.5 and abs(fit.beta[1] + 1) < 0.5
