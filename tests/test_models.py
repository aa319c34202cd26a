import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions import dist
from panelkit.functions.columns import one_hot
from panelkit.models import glm, gram, linear, robust, spec_tests
from panelkit.models.lag_products import lag_products


@pytest.fixture(scope="module")
def panel(spark):
    """Unbalanced panel with 24 regressors, an entity effect and AR noise."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(25):
        u = 0.0
        for t in range(1, 41):
            if rng.uniform() < 0.1:
                continue
            temp = 55 + 20 * np.sin(t / 6) + rng.normal(0, 5)
            x = rng.normal(size=6)
            u = 0.4 * u + rng.normal(0, 0.3)
            ly = i / 10 + 0.03 * temp - 0.0002 * temp**2 + 0.2 * x[0] - 0.1 * x[1] + 0.05 * (t % 11) + u
            rows.append((f"s{i:02d}", t, t % 11 + 1, t % 7, float(temp), *map(float, x), float(ly), int(rng.poisson(np.exp(min(ly, 4))))))
    df = spark.createDataFrame(rows, "e string, t int, month int, wd int, temp double, " + ", ".join(f"x{j} double" for j in range(6)) + ", ly double, y int")
    df = df.withColumn("temp2", F.col("temp") * F.col("temp"))
    df, m = one_hot(df, "month", list(range(1, 12)))
    df, w = one_hot(df, "wd", list(range(7)))
    df = df.persist()
    xs = ["temp", "temp2", *[f"x{j}" for j in range(6)], *m, *w]
    assert len(xs) == 24
    return df, xs


def to_numpy(df, xs, y):
    rows = df.orderBy("e", "t").select("e", "t", *xs, y).collect()
    e = np.unique([r[0] for r in rows], return_inverse=True)[1]
    t = np.array([r[1] for r in rows])
    return e, t, np.array([[float(v) for v in r[2:-1]] for r in rows]), np.array([float(r[-1]) for r in rows])


def test_within_equals_dummy_variable_regression(panel):
    df, xs = panel
    e, _, x, y = to_numpy(df, xs, "ly")
    d = np.column_stack([x, np.eye(25)[e]])
    b, rss, *_ = np.linalg.lstsq(d, y, rcond=None)
    fit = linear.within(df, "ly", xs, "e", ["t"])
    assert np.allclose(fit.beta, b[:24], atol=1e-8)
    fe = [r.fe for r in fit.fixef.orderBy("e").collect()]
    assert np.allclose(fe, b[24:], atol=1e-7)
    assert fit.rss == pytest.approx(rss[0], rel=1e-9) and fit.df_resid == len(y) - 25 - 24
    v = rss[0] / fit.df_resid * np.linalg.inv(d.T @ d)[:24, :24]
    assert np.allclose(np.sqrt(np.diag(fit.vcov)), np.sqrt(np.diag(v)), rtol=1e-6)


def test_pooled_equals_lstsq_and_ml(panel):
    df, xs = panel
    _, _, x, y = to_numpy(df, xs[:4], "ly")
    b = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
    fit = linear.ols_pooled(df, "ly", xs[:4])
    assert np.allclose(fit.beta, b, atol=1e-8)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    a = VectorAssembler(inputCols=xs[:4], outputCol="f").transform(df)
    m = LinearRegression(featuresCol="f", labelCol="ly", solver="normal").fit(a)
    assert np.allclose(fit.beta, [m.intercept, *m.coefficients], atol=1e-6)
    s = m.summary
    assert fit.r2 == pytest.approx(s.r2, abs=1e-9) and fit.adj_r2 == pytest.approx(s.r2adj, abs=1e-9)
    table = linear.coef_table(fit).collect()
    assert np.allclose([r.p_value for r in table], [s.pValues[-1], *s.pValues[:-1]], atol=1e-6)


def test_exact_panel(spark):
    """y = a_i + 2x without noise."""
    rows = [(f"e{i}", t, float(t * (i + 1) % 7), 10.0 * i + 2.0 * (t * (i + 1) % 7)) for i in range(4) for t in range(5)]
    df = spark.createDataFrame(rows, "e string, t int, x double, y double")
    fit = linear.within(df, "y", ["x"], "e", ["t"])
    assert fit.beta[0] == pytest.approx(2.0)
    assert [r.fe for r in fit.fixef.orderBy("e").collect()] == pytest.approx([0, 10, 20, 30], abs=1e-9)
    assert fit.scored().agg(F.max(F.abs("resid"))).first()[0] < 1e-9
    by = {r.e: (r.b0, r.b_x) for r in linear.ols_by_entity(df, "y", ["x"], "e").collect()}
    assert by["e3"] == pytest.approx((30.0, 2.0))


def test_by_entity_without_variation_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 5.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("b", 4.0, 5.0)], "e string, x double, y double")
    out = {r.e: r.b_x for r in linear.ols_by_entity(df, "y", ["x"], "e").collect()}
    assert out["a"] is None and out["b"] is not None


def test_collinear_columns_are_named_and_left_out(panel):
    df, _ = panel
    fit = linear.within(df.withColumn("dup", 2 * F.col("x0")), "ly", ["x0", "dup"], "e")
    assert (fit.xs, fit.dropped) == (["x0"], ["dup"])
    assert np.allclose(fit.beta, linear.within(df, "ly", ["x0"], "e").beta, rtol=1e-9)
    with pytest.raises(np.linalg.LinAlgError):
        linear.within(df.withColumn("dup", 2 * F.col("x0")), "ly", ["x0", "dup"], "e", qr=False)


def test_wide_and_narrow_moments_agree(panel):
    df, xs = panel
    cols = [F.col(c) for c in xs]
    wide = gram.moments(df, cols, F.col("x0") * F.col("x0"))
    narrow = gram.moments(df, cols[:5], F.col("x0") * F.col("x0"))
    assert np.allclose(wide.c[:5, :5], narrow.c, rtol=1e-10) and wide.n == pytest.approx(narrow.n)


def dense_poisson(x, y, e, g):
    d = np.column_stack([x, np.eye(g)[e]])
    b = np.zeros(d.shape[1])
    b[-g:] = [np.log(y[e == i].mean()) for i in range(g)]
    m = x.mean(0)
    d[:, : x.shape[1]] -= m
    for _ in range(60):
        mu = np.exp(d @ b)
        b = b + np.linalg.solve(d.T @ (d * mu[:, None]), d.T @ (y - mu))
    return b[: x.shape[1]], b[-g:] - b[: x.shape[1]] @ m, np.exp(d @ b)


@pytest.mark.parametrize("k", [3, 24])
def test_poisson_fe_equals_dense_fit(panel, k):
    df, xs = panel
    e, _, x, y = to_numpy(df, xs[:k], "y")
    b, fe, mu = dense_poisson(x, y, e, 25)
    fit = glm.poisson_fe(df, "y", xs[:k], "e", keys=["t"])
    assert fit.last_step < 1e-8
    assert np.allclose(fit.beta, b, atol=1e-7)
    assert np.allclose([r.fe for r in fit.fixef.orderBy("e").collect()], fe, atol=1e-6)
    dev = fit.scored().groupBy("e").agg(F.sum("resid").alias("s")).agg(F.max(F.abs("s"))).first()[0]
    assert dev < 1e-6


def test_poisson_month_effects_and_zero_entity(panel):
    df, _ = panel
    zero = df.limit(5).withColumn("e", F.lit("zero")).withColumn("y", F.lit(0))
    base = glm.poisson_fe(df, "y", ["x0"], "e", "month", list(range(1, 12)), ["t"])
    more = glm.poisson_fe(df.unionByName(zero), "y", ["x0"], "e", "month", list(range(1, 12)), ["t"])
    assert base.month_effects[1] == 0.0 and len(base.month_effects) == 11
    assert np.allclose(base.beta, more.beta, atol=1e-8)
    assert more.n_entities == 25 and more.n == base.n
    one = glm.poisson_fe(df.filter("month = 3"), "y", ["x0"], "e")
    two = glm.poisson_fe(df.filter("month = 3"), "y", ["x0"], "e", "month", [3])
    assert np.allclose(one.beta, two.beta)


def test_poisson_by_entity_matches_single_fits(panel):
    df, _ = panel
    out = {r.e: (r.b0, r.b1, r.step) for r in glm.glm_poisson_by_entity(df, "y", "temp", "e").filter("converged").collect()}
    one = {r.term: r.estimate for r in glm.glm_poisson(df.filter("e = 's07'"), "y", ["temp"]).collect()}
    assert out["s07"][:2] == pytest.approx((one["(Intercept)"], one["temp"]), abs=1e-6)
    assert max(abs(v[2]) for v in out.values()) < 1e-6


def demeaned(x, e):
    return x - np.array([x[e == i].mean(0) for i in range(e.max() + 1)])[e]


def test_robust_covariances(panel):
    df, xs = panel
    xs = xs[:4]
    e, t, x, y = to_numpy(df, xs, "ly")
    fit = linear.within(df, "ly", xs, "e", ["t"])
    xd, yd = demeaned(x, e), demeaned(y, e)
    a = np.linalg.inv(xd.T @ xd)
    u = yd - xd @ fit.beta
    scores = [xd[e == i].T @ u[e == i] for i in range(25)]
    want = a @ sum(np.outer(s, s) for s in scores) @ a
    assert np.allclose(robust.vcov_arellano(fit), want, rtol=1e-6, atol=1e-14)
    h = np.einsum("ij,jk,ik->i", xd, a, xd)
    s2 = [np.mean((u[e == i] / (1 - h[e == i])) ** 2) for i in range(25)]
    want = a @ sum(s2[i] * xd[e == i].T @ xd[e == i] for i in range(25)) @ a
    assert np.allclose(robust.vcov_white2_hc3(fit), want, rtol=1e-6, atol=1e-14)


def test_poisson_two_way_cluster(panel):
    df, xs = panel
    xs = xs[2:5]
    e, t, x, y = to_numpy(df, xs, "y")
    _, _, mu = dense_poisson(x, y, e, 25)
    xb = np.array([(x[e == i] * mu[e == i, None]).sum(0) / mu[e == i].sum() for i in range(25)])[e]
    s, bread = (x - xb) * (y - mu)[:, None], np.linalg.inv(((x - xb) * mu[:, None]).T @ (x - xb))
    meat = lambda g: sum(np.outer(v, v) for v in (s[g == c].sum(0) for c in np.unique(g)))
    n, g = len(y), 25
    want = bread @ (meat(e) + meat(t) - s.T @ s) @ bread * g / (g - 1) * (n - 1) / (n - 4)
    fit = glm.poisson_fe(df, "y", xs, "e", keys=["t"])
    assert np.allclose(robust.vcov_poisson_cluster(fit, ["e", "t"]), want, rtol=1e-5)


def test_spec_tests_react(panel):
    df, xs = panel
    pool = linear.ols_pooled(df, "ly", xs[:4], ["e", "t"])
    fit = linear.within(df, "ly", xs[:4], "e", ["t"])
    assert spec_tests.f_test_nested(pool, fit).first().p_value < 1e-6
    assert spec_tests.breusch_pagan_lm(pool, "e").first().p_value < 1e-6
    assert spec_tests.wooldridge_effects(pool, "e").first().p_value < 1e-3
    assert spec_tests.wooldridge_ar1(fit, "t").first().p_value < 1e-3
    bg = spec_tests.breusch_godfrey(fit, "t").first()
    assert bg.p_value < 1e-3 and bg.df1 == fit.fixef.agg(F.min("n_i")).first()[0]
    with pytest.raises(ValueError):
        spec_tests.breusch_godfrey(fit, "t", 0)


def direct_godfrey(e, t, x, u, order):
    """N R2 with a column per lag, and how many rows there are."""
    known = {k: v for k, v in zip(zip(e.tolist(), t.tolist()), u.tolist(), strict=True)}
    x = x - np.array([x[e == i].mean(0) for i in e])
    lag = np.array([[known.get((i, s - k), 0.0) for k in range(1, order + 1)] for i, s in zip(e.tolist(), t.tolist(), strict=True)])
    z = np.hstack([x, lag])
    return len(u) * (u @ z @ np.linalg.lstsq(z, u, rcond=None)[0]) / (u @ u)


@pytest.mark.parametrize("order,size", [(1, 4096), (3, 8), (None, 16)])
def test_godfrey_equals_a_column_per_lag(panel, order, size, monkeypatch):
    df, xs = panel
    fit = linear.within(df, "ly", xs[:4], "e", ["t"])
    rows = fit.scored().select("e", "t", *xs[:4], "resid")
    e, t, x, u = to_numpy(rows, xs[:4], "resid")
    products = spec_tests.lag_products
    monkeypatch.setattr(spec_tests, "lag_products", lambda *a: products(*a, size=size))
    got = spec_tests.breusch_godfrey(fit, "t", order).first()
    assert got.statistic == pytest.approx(direct_godfrey(e, t, x, u, int(got.df1)), rel=1e-8)


def test_lag_products_of_a_long_hot_entity(spark):
    """300 lags of one entity with nearly all rows, over slices, with gaps and short chunks of rows."""
    rng = np.random.default_rng(3)
    times = np.sort(rng.choice(6000, 5000, replace=False))
    rows = [("hot", int(s), float(v), float(w)) for s, v, w in zip(times, rng.normal(size=5000), rng.normal(size=5000), strict=True)]
    rows += [("a", 5, 1.0, 2.0), ("a", 400, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "e string, t int, u double, x double")
    got = lag_products(df, "e", "t", "u", ["x"], 300)
    want = np.zeros((302, 302))
    for name in ("hot", "a"):
        line = {s: (u, x) for n, s, u, x in rows if n == name}
        z = np.array([[x, *[line.get(s - k, (0.0,))[0] for k in range(1, 301)], u] for s, (u, x) in line.items()])
        want += z.T @ z
    assert np.allclose(got, want, atol=1e-8)
    assert not lag_products(df.limit(0), "e", "t", "u", ["x"], 2).any()


def test_logit_of_missingness(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=800)
    m = rng.uniform(size=800) < 1 / (1 + np.exp(1 - 0.8 * x))
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, m)], "x double, missing boolean")
    b = np.zeros(2)
    d = np.column_stack([np.ones(800), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ b))
        b = b + np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]), d.T @ (m - p))
    out = {r.term: r.estimate for r in glm.glm_binomial(df, "missing", ["x"]).collect()}
    assert [out["(Intercept)"], out["x"]] == pytest.approx(list(b), abs=1e-7)


def test_distribution_tables():
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert dist.t_quantile(0.975, 1) == pytest.approx(12.70620474, abs=1e-6)
    assert dist.t_quantile(0.025, 5) == pytest.approx(-2.570581836, abs=1e-8)
    assert dist.t_quantile(0.975, 29390) == pytest.approx(1.960, abs=1e-3)
    assert np.isnan(dist.t_quantile(0.975, 0))
    assert dist.t_two_sided(1.959963984540054, 1e12) == pytest.approx(0.05, abs=1e-10)
    assert dist.f_upper(1.959963984540054**2, 1, 1e12) == pytest.approx(0.05, abs=1e-10)
    assert dist.t_two_sided(2.0, 99_999) == pytest.approx(dist.t_two_sided(2.0, 100_001), abs=1e-8)
    assert dist.f_upper(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.chi2_upper(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert dist.chi2_upper(18.30703805, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-8)


@pytest.mark.parametrize("rho, low, high", [(0.0, 0, 30), (0.5, 100, None)])
def test_locally_robust_ar1_with_entity_effects_and_gaps(spark, rho, low, high):
    """Ten simulated panels: rejects serial correlation, but not entity effects."""
    rng = np.random.default_rng(9)
    total = 0.0
    for _ in range(10):
        rows = []
        for i in range(40):
            mu, u = rng.normal(), 0.0
            for t in range(20):
                u = rho * u + rng.normal()
                if rng.uniform() > 0.15:
                    rows.append((i, t, float(rng.normal()), float(mu + u)))
        df = spark.createDataFrame(rows, "e int, t int, x double, y double").coalesce(2)
        total += spec_tests.locally_robust_ar1(linear.ols_pooled(df, "y", ["x"], ["e", "t"]), "e", "t").first().statistic
    assert total > low and (high is None or total < high)
