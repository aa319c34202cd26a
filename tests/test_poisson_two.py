"""Poisson regression with two large sets of effects."""

import numpy as np
from pyspark.sql import functions as F

from panelkit.models import glm, linear, poisson_two


def rows(spark, entities, levels, share, seed=3):
    rng = np.random.default_rng(seed)
    e, c = (a.ravel() for a in np.meshgrid(np.arange(entities), np.arange(levels), indexing="ij"))
    keep = rng.random(len(e)) < share
    e, c = e[keep], c[keep]
    x = np.column_stack([rng.normal(size=len(e)) + 0.02 * (e % 7), 3 + rng.random(len(e)) * (1 + c % 3)])
    mu = np.exp(0.3 * x[:, 0] - 0.2 * x[:, 1] + 0.4 * rng.normal(size=entities)[e] + 0.4 * rng.normal(size=levels)[c] + 1)
    y = rng.poisson(mu)
    y[(e == 1) | (c == 2)] = 0
    data = [(int(a), int(b), float(u), float(v), int(n)) for a, b, (u, v), n in zip(e, c, x, y, strict=True)]
    return spark.createDataFrame(data, "e int, c int, x1 double, x2 double, y int")


def test_equals_the_fit_with_dummies(spark):
    df = rows(spark, 40, 9, 0.7).filter("c <> 2")
    levels = [c for c in range(9) if c != 2]
    want = glm.poisson_fe(df, "y", ["x1", "x2"], "e", "c", levels)
    got = poisson_two.poisson_two_way(df, "y", ["x1", "x2"], "e", "c")
    assert np.allclose(got.beta, want.beta[:2], atol=1e-9) and np.allclose(got.vcov, want.vcov[:2, :2], rtol=1e-6)
    effects = {r["c"]: r["fe"] for r in got.other_fixef.collect()}
    assert all(abs(effects[c] - want.month_effects[c]) < 1e-8 for c in levels)
    fe = {r["e"]: r["fe"] for r in want.fixef.collect()}
    assert {r["e"] for r in got.fixef.collect()} == set(fe) and all(abs(r["fe"] - fe[r["e"]]) < 1e-8 for r in got.fixef.collect())
    assert linear.coef_table(got).count() == 2
    got.release()


def test_first_order_conditions(spark):
    """At the maximum, residuals add up to zero in every level of both sides and are orthogonal to x."""
    df = rows(spark, 60, 3000, 0.05)
    fit = poisson_two.poisson_two_way(df, "y", ["x1", "x2"], "e", "c")
    s = fit.scored().persist()
    for side in ("e", "c"):
        worst = s.groupBy(side).agg((F.abs(F.sum("resid")) / F.sum("y")).alias("u")).agg(F.max("u")).first()[0]
        assert worst < 1e-7
        assert s.filter((F.col("e") == 1) | (F.col("c") == 2)).count() == 0
    r = s.agg(*[F.sum(F.col(x) * F.col("resid")) for x in ("x1", "x2")], F.sum("y")).first()
    assert abs(r[0]) < 1e-7 * r[2] and abs(r[1]) < 1e-7 * r[2]
    assert fit.n == s.count()
    s.unpersist()
    fit.release()
