"""Panel regressions, count models, tests, robust errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import columns as fc
from ..functions.columns import guarded_log, one_hot
from ..models import fgls, glm, linear, robust, spec_tests
from ..models.poisson_two import poisson_two_way
from ..operators import describe, joins, lags, ranking, smooth
from .base import cte, longs, pa, pb, query, raw, rounded
from .describing import lowess_ctes
from .model_sql import ITERATIONS, inverse_cte, linear_ctes, poisson_ctes

linear_ctes("w", "pb", "ly", "x1", "x2", "l_suppkey")
linear_ctes("p", "pb", "ly", "x1", "x2", None)
cte("pbt", "SELECT *, CAST(t AS DOUBLE) / 100 AS tt FROM pb", ("pb",))
linear_ctes("wt", "pbt", "ly", "x1", "tt", "l_suppkey")

XS = ["x1", "x2"]


def within_fit(spark, sf):
    return linear.within(pb(spark, sf), "ly", XS, "l_suppkey", ["t", "month"])


def pooled_fit(spark, sf):
    return linear.ols_pooled(pb(spark, sf), "ly", XS, ["l_suppkey", "t"])


# ---- the minimum slice -------------------------------------------------------
cte(
    "flag",
    """SELECT a.user_id, ln(CAST(a.y AS DOUBLE)) AS ly, ln(CAST(b.y AS DOUBLE)) AS ll FROM pa a
       JOIN pa b ON a.user_id = b.user_id AND b.t = a.t - 7""",
    ("pa",),
)


@query(
    "flagship_within_lag",
    """SELECT count(*) AS n, round(sum(d * e) / sum(d * d), 6) + 0.0 AS slope FROM (
         SELECT ll - avg(ll) OVER (PARTITION BY user_id) AS d, ly - avg(ly) OVER (PARTITION BY user_id) AS e FROM flag)""",
    ("flag",),
)
def _(spark, sf):
    """Daily panel from events, weekly gap-aware lag, within slope of ln y on ln lag."""
    df = lags.gap_aware_lags(pa(spark, sf).select("user_id", "t", "y"), "user_id", "t", "y", {"lag7": 7})
    df = df.withColumns({"ly": guarded_log(F.col("y")), "ll": guarded_log(F.col("lag7"))})
    dm = linear.demean(df.na.drop("any", subset=["ly", "ll"]), "user_id", ["ly", "ll"])
    slope = F.sum(F.col("ll_dm") * F.col("ly_dm")) / F.sum(F.col("ll_dm") * F.col("ll_dm"))
    return rounded(dm.agg(F.count(F.lit(1)).alias("n"), slope.alias("slope")), "slope")


@query(
    "w9_demean",
    "SELECT l_suppkey, t, round(d1, 6) + 0.0 AS x1_dm, round(dy, 6) + 0.0 AS ly_dm FROM wd",
    ("wd",),
)
def _(spark, sf):
    df = pb(spark, sf).select("l_suppkey", "t", "x1", "ly")
    out = linear.demean(df, "l_suppkey", ["x1", "ly"])
    return rounded(out.select("l_suppkey", "t", "x1_dm", "ly_dm"), "x1_dm", "ly_dm")


# ---- linear models ---------------------------------------------------------------
def coef_sql(p: str, rows: list[tuple[str, str, str]]) -> str:
    """(term, estimate, variance) rows as a coefficient table."""
    return " UNION ALL ".join(
        f"SELECT '{t}' AS term, round({b}, 6) + 0.0 AS estimate, round(sqrt({v}), 6) + 0.0 AS std_error, round({b} / sqrt({v}), 4) + 0.0 AS statistic FROM {p}f"
        for t, b, v in rows
    )


def coef_out(table):
    out = rounded(table.drop("p_value"), "estimate", "std_error")
    return rounded(out, "statistic", digits=4)


@query(
    "m1_ols_pooled",
    coef_sql(
        "p",
        [
            ("(Intercept)", "b0", "s2 * (1.0 / n + m1 * m1 * i11 + 2 * m1 * m2 * i12 + m2 * m2 * i22)"),
            ("x1", "b1", "s2 * i11"),
            ("x2", "b2", "s2 * i22"),
        ],
    ),
    ("pf",),
)
def _(spark, sf):
    return coef_out(linear.coef_table(pooled_fit(spark, sf)))


cte("pap", "SELECT user_id, t, d, y, x / 100 AS xs, rain, 1 AS one FROM pa", ("pa",))
poisson_ctes("gp", "pap", "y", "xs", "rain", "one")
poisson_ctes("pq", "pap", "y", "xs", "rain", "user_id")
cte("paw", "SELECT *, CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS weekend FROM pap", ("pap",))
poisson_ctes("pw", "paw", "y", "xs", "weekend", "user_id")


def pap(spark, sf):
    return pa(spark, sf).withColumn("xs", F.col("x") / 100)


@query(
    "m2_glm_poisson",
    """SELECT term, round(b, 6) + 0.0 AS estimate, round(sqrt(v), 6) + 0.0 AS std_error, round(b / sqrt(v), 4) + 0.0 AS statistic FROM (
         SELECT 'xs' AS term, b1 AS b, v11 AS v FROM gpf UNION ALL SELECT 'rain', b2, v22 FROM gpf UNION ALL
         SELECT '(Intercept)', fe, 1 / yt + xb1 * xb1 * v11 + 2 * xb1 * xb2 * v12 + xb2 * xb2 * v22 FROM gpf, gpe)""",
    ("gpf", "gpe"),
)
def _(spark, sf):
    return coef_out(glm.glm_poisson(pap(spark, sf), "y", ["xs", "rain"]))


def _logit_ctes() -> None:
    cte("lg", "SELECT CASE WHEN y IS NULL THEN 1.0::DOUBLE ELSE 0 END AS yy, x / 100 AS z FROM raw", ("raw",))
    cte("lgb0", "SELECT ln(avg(yy) / (1 - avg(yy))) AS b0, CAST(0 AS DOUBLE) AS b1, CAST(NULL AS DOUBLE) AS v0, CAST(NULL AS DOUBLE) AS v1 FROM lg", ("lg",))
    for i in range(ITERATIONS):
        cte(
            f"lgb{i + 1}",
            f"""SELECT b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1,
                  h11 / (h00 * h11 - h01 * h01) AS v0, h00 / (h00 * h11 - h01 * h01) AS v1 FROM (
                SELECT max(b0) AS b0, max(b1) AS b1, sum(yy - p) AS g0, sum((yy - p) * z) AS g1, sum(p * (1 - p)) AS h00,
                  sum(p * (1 - p) * z) AS h01, sum(p * (1 - p) * z * z) AS h11
                FROM (SELECT *, 1 / (1 + exp(-b0 - b1 * z)) AS p FROM lg, lgb{i}))""",
            ("lg", f"lgb{i}"),
        )


_logit_ctes()


@query(
    "m3_glm_binomial",
    " UNION ALL ".join(
        f"SELECT '{t}' AS term, round({b}, 4) + 0.0 AS estimate, round(sqrt({v}), 4) + 0.0 AS std_error FROM lgb{ITERATIONS}"
        for t, b, v in (("xs", "b1", "v1"), ("(Intercept)", "b0", "v0"))
    ),
    (f"lgb{ITERATIONS}",),
)
def _(spark, sf):
    df = raw(spark, sf).select((F.col("x") / 100).alias("xs"), F.col("y").isNull().alias("missing_indicator"))
    out = glm.glm_binomial(df, "missing_indicator", ["xs"])
    return rounded(out.select("term", "estimate", "std_error"), "estimate", "std_error", digits=4)


BY_ENTITY = 12  # steps of the SQL; the difference of the last two tells convergence


def _by_entity_ctes(p: str, key: str) -> None:
    cte(p, f"SELECT {key}, CAST(y AS DOUBLE) AS yy, xs, xs - avg(xs) OVER (PARTITION BY {key}) AS z, avg(xs) OVER (PARTITION BY {key}) AS mx FROM pap", ("pap",))
    cte(f"{p}b0", f"SELECT {key}, count(*) AS n_i, ln(avg(yy)) AS b0, CAST(0 AS DOUBLE) AS b1, max(mx) AS mx FROM {p} GROUP BY 1", (p,))
    for i in range(BY_ENTITY):
        cte(
            f"{p}b{i + 1}",
            f"""SELECT {key}, n_i, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1, mx FROM (
                SELECT {key}, max(n_i) AS n_i, max(b0) AS b0, max(b1) AS b1, max(mx) AS mx, sum(yy - m) AS g0, sum((yy - m) * z) AS g1,
                  sum(m) AS h00, sum(m * z) AS h01, sum(m * z * z) AS h11
                FROM (SELECT {key}, yy, z, n_i, b0, b1, b.mx, exp(b0 + b1 * z) AS m FROM {p} JOIN {p}b{i} b USING ({key})) GROUP BY 1)""",
            (p, f"{p}b{i}"),
        )
    cte(
        f"{p}f",
        f"""SELECT {key}, n_i, a.b0 - a.b1 * a.mx AS b0, a.b1 AS b1,
              coalesce(greatest(abs(a.b0 - b.b0), abs(a.b1 - b.b1)) <= 1e-8 * (1 + abs(a.b0) + abs(a.b1)), FALSE) AS converged
            FROM {p}b{BY_ENTITY} a JOIN (SELECT {key}, b0, b1 FROM {p}b{BY_ENTITY - 1}) b USING ({key})""",
        (f"{p}b{BY_ENTITY}", f"{p}b{BY_ENTITY - 1}"),
    )


_by_entity_ctes("be", "user_id")
_by_entity_ctes("bp", "one")


@query(
    "m4_glm_poisson_by_entity",
    "SELECT user_id, n_i, round(b0, 4) + 0.0 AS b0, round(b1, 4) + 0.0 AS b1, converged FROM bef",
    ("bef",),
)
def _(spark, sf):
    out = glm.glm_poisson_by_entity(pap(spark, sf), "y", "xs", "user_id")
    return rounded(out.drop("step"), "b0", "b1", digits=4)


cte("bel", "SELECT 'b0' AS coef, b0 AS v FROM bef WHERE converged UNION ALL SELECT 'b1', b1 FROM bef WHERE converged", ("bef",))
_STATS = {"min": "min(v)", "q1": "quantile_cont(v, 0.25)", "median": "quantile_cont(v, 0.5)", "mean": "avg(v)", "q3": "quantile_cont(v, 0.75)", "max": "max(v)"}


@query(
    "m4_coefficient_summary",
    "SELECT coef, stat, round(value, 4) + 0.0 AS value FROM ("
    + " UNION ALL ".join(f"SELECT coef, '{k}' AS stat, {v} AS value FROM bel GROUP BY coef" for k, v in _STATS.items())
    + " UNION ALL SELECT 'b0', 'all', b0 FROM bpf UNION ALL SELECT 'b1', 'all', b1 FROM bpf)",
    ("bel", "bpf"),
)
def _(spark, sf):
    """Distribution of the coefficients of all entities beside the fit on all rows."""
    df = pap(spark, sf)
    by = glm.glm_poisson_by_entity(df, "y", "xs", "user_id")
    return rounded(glm.coefficient_summary(by, glm.glm_poisson(df, "y", ["xs"]), "xs"), "value", digits=4)


@query(
    "m4_coefficient_histogram",
    """SELECT CAST(i AS INTEGER) AS bin, CASE WHEN i > 0 THEN -2.0::DOUBLE + (i - 1) * 0.25::DOUBLE END AS left, CASE WHEN i <= 16 THEN -2.0::DOUBLE + i * 0.25::DOUBLE END AS right,
         coalesce(n, 0) AS n FROM (SELECT unnest(range(18)) AS i) LEFT JOIN (
           SELECT CASE WHEN v < -2 THEN 0 WHEN v > 2 THEN 17 ELSE greatest(1, least(16, ceil((v + 2) / 0.25))) END AS i, count(*) AS n
           FROM bel WHERE coef = 'b1' GROUP BY 1) USING (i)""",
    ("bel",),
)
def _(spark, sf):
    """Slopes of all entities in fixed bins."""
    by = glm.glm_poisson_by_entity(pap(spark, sf), "y", "xs", "user_id")
    return glm.coefficient_histogram(by, "b1", -2.0, 2.0, 0.25)


@query(
    "m5_ols_by_entity",
    """SELECT l_suppkey, n_i, round(b0, 6) + 0.0 AS b0, round(b1, 6) + 0.0 AS b_x1, round(b2, 6) + 0.0 AS b_x2,
       round(rss, 6) + 0.0 AS rss, df AS df_resid FROM wv""",
    ("wv",),
)
def _(spark, sf):
    out = linear.ols_by_entity(pb(spark, sf), "ly", XS, "l_suppkey")
    return rounded(out, "b0", "b_x1", "b_x2", "rss")


@query("m6_within", coef_sql("w", [("x1", "b1", "s2 * i11"), ("x2", "b2", "s2 * i22")]), ("wf",))
def _(spark, sf):
    return coef_out(linear.coef_table(within_fit(spark, sf)))


FULL = ["x", "x_sq", "rain", *[f"weekday_{d}" for d in cal.WEEKDAY_LEVELS[1:]], "cold", "ll"]


def _full_ctes() -> None:
    number = {d: k for k, d in enumerate(cal.WEEKDAYS, 1)}
    days = ", ".join(f"CASE WHEN isodow(a.d) = {number[d]} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for d in cal.WEEKDAY_LEVELS[1:])
    cte(
        "fl0",
        f"""SELECT row_number() OVER () AS r, a.user_id, ln(CAST(a.y AS DOUBLE)) AS ly,
              [a.x, a.x * a.x, a.rain, {days}, CASE WHEN a.temp <= 49.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, ln(CAST(b.y AS DOUBLE))] AS xs
            FROM pa a JOIN pa b ON a.user_id = b.user_id AND b.t = a.t - 7 WHERE a.y > 0 AND b.y > 0 AND a.x IS NOT NULL""",
        ("pa",),
    )
    cte("fl1", f"SELECT r, user_id, ly, unnest(xs) AS v, unnest(range(1, {len(FULL) + 1})) AS j FROM fl0", ("fl0",))
    cte(
        "fl",
        "SELECT r, user_id, j, v - avg(v) OVER (PARTITION BY user_id, j) AS d, ly - avg(ly) OVER (PARTITION BY user_id, j) AS e FROM fl1",
        ("fl1",),
    )
    cte("flc", "SELECT a.j AS i, b.j AS j, sum(a.d * b.d) AS v FROM fl a JOIN fl b USING (r) GROUP BY 1, 2", ("fl",))
    inverse_cte("flv", "SELECT i, j, v FROM flc", len(FULL), ("flc",))
    cte("flq", "SELECT j, sum(d * e) AS q FROM fl GROUP BY 1", ("fl",))
    cte("flb", "SELECT v.i, sum(v.v * q.q) AS b FROM flv v JOIN flq q USING (j) GROUP BY 1", ("flv", "flq"))
    cte(
        "fls",
        f"""SELECT (tss - fitted) / (n - g - {len(FULL)}) AS s2 FROM (SELECT sum(b.b * q.q) AS fitted FROM flb b JOIN flq q ON b.i = q.j),
              (SELECT sum(e * e) AS tss, count(*) AS n, count(DISTINCT user_id) AS g FROM fl WHERE j = 1)""",
        ("flb", "flq", "fl"),
    )


_full_ctes()


@query(
    "m6_within_full",
    f"""SELECT {FULL!r}[b.i] AS term, round(b.b, 6) + 0.0 AS estimate, round(sqrt(s2 * v.v), 6) + 0.0 AS std_error,
          round(b.b / sqrt(s2 * v.v), 4) + 0.0 AS statistic FROM flb b JOIN flv v ON v.i = b.i AND v.j = b.i, fls""",
    ("flb", "flv", "fls"),
)
def _(spark, sf):
    """Quadratic term, weekday dummies, flag and weekly lag (11 columns, by QR)."""
    df = cal.add_calendar(lags.gap_aware_lags(pa(spark, sf), "user_id", "t", "y", {"lag7": 7}), "d")
    df, days = one_hot(df, "weekday", cal.WEEKDAY_LEVELS)
    df = df.withColumns(
        {
            "x_sq": F.col("x") * F.col("x"), "ly": guarded_log(F.col("y")), "ll": guarded_log(F.col("lag7")),
            "cold": (F.col("temp") <= 49.5).cast("double"),
        }
    )
    fit = linear.within(df, "ly", ["x", "x_sq", "rain", *days, "cold", "ll"], "user_id", ["t"])
    return coef_out(linear.coef_table(fit))


@query("m7_fixef", "SELECT l_suppkey, n_i, round(fe, 6) + 0.0 AS fe FROM wfe", ("wfe",))
def _(spark, sf):
    return rounded(within_fit(spark, sf).fixef, "fe")


def poisson_fit(spark, sf):
    return glm.poisson_fe(pap(spark, sf), "y", ["xs", "rain"], "user_id", keys=["t"])


def poisson_two(spark, sf):
    df = pap(spark, sf).withColumn("weekend", (F.weekday("d") >= 5).cast("int"))
    return glm.poisson_fe(df, "y", ["xs"], "user_id", "weekend", [0, 1], ["t"])


def _poisson_coef_sql(p: str, terms: tuple[str, str]) -> str:
    return coef_sql(p, [(terms[0], "b1", "v11"), (terms[1], "b2", "v22")])


@query("m8_poisson_fe_one", _poisson_coef_sql("pq", ("xs", "rain")), ("pqf",))
def _(spark, sf):
    return coef_out(linear.coef_table(poisson_fit(spark, sf)))


@query("m9_poisson_fe_two", _poisson_coef_sql("pw", ("xs", "weekend_1")), ("pwf",))
def _(spark, sf):
    return coef_out(linear.coef_table(poisson_two(spark, sf)))


MONTHS = [*XS, *[f"month_{m}" for m in range(2, 13)]]


def _months_ctes() -> None:
    """Newton's method with supplier effects concentrated out and months as columns."""
    k = len(MONTHS)
    dummies = ", ".join(f"CASE WHEN month = {m} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for m in range(2, 13))
    cte("mo", f"SELECT row_number() OVER () AS r, l_suppkey, CAST(y AS DOUBLE) AS y, [x1, x2, {dummies}] AS xs FROM pb", ("pb",))
    cte("mob0", f"SELECT list_transform(range(1, {k + 1}), lambda i: 0.0::DOUBLE) AS b")
    cte("mop", f"SELECT unnest(range(1, {k + 1})) AS i")
    cte("mopp", "SELECT p.i, q.i AS j FROM mop p, mop q", ("mop",))
    for n in range(ITERATIONS + 1):
        cte(f"mow{n}", f"SELECT r, l_suppkey, y, xs, exp(list_inner_product(xs, b)) AS w FROM mo, mob{n}", ("mo", f"mob{n}"))
        cte(
            f"moe{n}",
            f"""SELECT l_suppkey, max(rate) AS rate, list(xb ORDER BY i) AS xb FROM (
                  SELECT l_suppkey, i, sum(y) / sum(w) AS rate, sum(w * xs[i]) / sum(w) AS xb FROM mow{n}, mop GROUP BY 1, 2) GROUP BY 1""",
            (f"mow{n}", "mop"),
        )
        cte(
            f"mod{n}",
            f"""SELECT r, y, w * rate AS lam, list_transform(xs, lambda x, i: x - xb[i]) AS d FROM mow{n} JOIN moe{n} USING (l_suppkey)""",
            (f"mow{n}", f"moe{n}"),
        )
        inverse_cte(f"mov{n}", f"SELECT i, j, sum(lam * d[i] * d[j]) AS v FROM mod{n}, mopp GROUP BY 1, 2", k, (f"mod{n}", "mopp"))
        if n < ITERATIONS:
            cte(f"mog{n}", f"SELECT i, sum((y - lam) * d[i]) AS v FROM mod{n}, mop GROUP BY 1", (f"mod{n}", "mop"))
            cte(
                f"mob{n + 1}",
                f"""SELECT list(b[i] + v ORDER BY i) AS b FROM mob{n}, (
                      SELECT h.i, sum(h.v * g.v) AS v FROM mov{n} h JOIN mog{n} g ON h.j = g.i GROUP BY 1)""",
                (f"mob{n}", f"mov{n}", f"mog{n}"),
            )
    cte("mof", f"SELECT v.i, b[v.i] AS b, sqrt(v.v) AS se FROM mov{ITERATIONS} v, mob{ITERATIONS} WHERE v.i = v.j", (f"mov{ITERATIONS}", f"mob{ITERATIONS}"))


_months_ctes()
MONTHS_SQL = f"""SELECT {MONTHS!r}[i] AS term, round(b, 6) + 0.0 AS estimate, round(se, 6) + 0.0 AS std_error, round(b / se, 4) + 0.0 AS statistic FROM mof"""


@query("m9_poisson_fe_months", MONTHS_SQL, ("mof",))
def _(spark, sf):
    """Supplier and month effects (13 columns)."""
    fit = glm.poisson_fe(pb(spark, sf), "y", XS, "l_suppkey", "month", list(range(1, 13)), ["t"])
    return coef_out(linear.coef_table(fit))


@query(
    "m9_poisson_two_way",
    f"""SELECT {MONTHS!r}[i] AS term, round(b, 6) + 0.0 AS estimate, CASE WHEN i <= {len(XS)} THEN round(se, 6) + 0.0 END AS std_error FROM mof
        UNION ALL SELECT 'month_1', 0.0::DOUBLE, CAST(NULL AS DOUBLE)""",
    ("mof",),
)
def _(spark, sf):
    """The same fit with both effects concentrated out: slopes, and the months as levels of the second side."""
    fit = poisson_two_way(pb(spark, sf), "y", XS, "l_suppkey", "month", ["t"])
    slopes = linear.coef_table(fit).select("term", "estimate", "std_error")
    months = fit.other_fixef.select(F.format_string("month_%d", "month").alias("term"), F.col("fe").alias("estimate"), F.lit(None).cast("double").alias("std_error"))
    return rounded(slopes.unionByName(months), "estimate", "std_error")


@query(
    "m10_poisson_fixef",
    """SELECT 'user_id' AS kind, user_id AS level, round(fe, 6) + 0.0 AS fe FROM pwe
       UNION ALL SELECT 'weekend', 0, 0.0::DOUBLE UNION ALL SELECT 'weekend', 1, round(b2, 6) + 0.0 FROM pwf""",
    ("pwe", "pwf"),
)
def _(spark, sf):
    fit = poisson_two(spark, sf)
    ent = fit.fixef.select(F.lit("user_id").alias("kind"), F.col("user_id").alias("level"), "fe")
    cat = spark.createDataFrame(
        [("weekend", int(k), v) for k, v in fit.month_effects.items()], "kind string, level bigint, fe double"
    )
    return rounded(ent.unionByName(cat), "fe")


@query("m11_fgls_within")
def _(spark, sf):
    df = pb(spark, sf)
    return coef_out(linear.coef_table(fgls.fgls_within(df, "ly", XS, "l_suppkey", "t")))


FGLS_T = 6  # periods of the short panel


def _fgls_ctes() -> None:
    """Residual covariance of the within fit, inverted by elimination; the last time is redundant once demeaned."""
    cte("pby", f"""SELECT l_suppkey, CAST(floor((t - 1) / 14) AS INTEGER) AS t, CAST(sum(y) AS DOUBLE) AS y, avg(x1) AS x1, avg(x2) AS x2,
      ln(CAST(sum(y) AS DOUBLE)) AS ly FROM pb GROUP BY 1, 2""", ("pb",))
    linear_ctes("wy", "pby", "ly", "x1", "x2", "l_suppkey")
    cte("fo", """SELECT a.t AS i, b.t AS j, sum(a.u * b.u) / count(*) AS v FROM wyd a JOIN wyd b USING (l_suppkey) GROUP BY 1, 2""", ("wyd",))
    cte("fa0", f"""SELECT i, j, v FROM fo WHERE i < {FGLS_T - 1} AND j < {FGLS_T - 1} UNION ALL
      SELECT i, {FGLS_T} + i, 1.0::DOUBLE FROM fo WHERE j = 0 AND i < {FGLS_T - 1}""", ("fo",))
    for k in range(FGLS_T - 1):
        # row k is scaled, then taken from the others; absent cells are zero
        cte(f"fr{k}", f"SELECT r.j, r.v / d.v AS v FROM fa{k} r, fa{k} d WHERE r.i = {k} AND d.i = {k} AND d.j = {k}", (f"fa{k}",))
        cte(
            f"fa{k + 1}",
            f"""SELECT i, j, sum(v) AS v FROM (
                  SELECT i, j, v FROM fa{k} WHERE i <> {k} UNION ALL SELECT {k}, j, v FROM fr{k} UNION ALL
                  SELECT c.i, r.j, -c.v * r.v FROM fa{k} c, fr{k} r WHERE c.j = {k} AND c.i <> {k}) GROUP BY 1, 2""",
            (f"fa{k}", f"fr{k}"),
        )
    cte(
        "fm",
        f"""SELECT sum(a.d1 * o.v * b.d1) AS a, sum(a.d1 * o.v * b.d2) AS b, sum(a.d2 * o.v * b.d2) AS c, sum(a.d1 * o.v * b.dy) AS p,
              sum(a.d2 * o.v * b.dy) AS q
            FROM wyd a JOIN (SELECT i, j - {FGLS_T} AS j, v FROM fa{FGLS_T - 1} WHERE j >= {FGLS_T}) o ON a.t = o.i
            JOIN wyd b ON b.l_suppkey = a.l_suppkey AND b.t = o.j""",
        ("wyd", f"fa{FGLS_T - 1}"),
    )
    cte("fgf", """SELECT (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2, c / (a * c - b * b) AS v11,
      a / (a * c - b * b) AS v22 FROM fm""", ("fm",))


_fgls_ctes()


@query("m11_fgls_short", coef_sql("fg", [("x1", "b1", "v11"), ("x2", "b2", "v22")]), ("fgf",))
def _(spark, sf):
    """Supplier totals over periods of 14 months, which every supplier has."""
    df = pb(spark, sf).withColumn("t", F.floor((F.col("t") - 1) / 14).cast("int")).groupBy("l_suppkey", "t")
    df = df.agg(F.sum("y").alias("y"), F.avg("x1").alias("x1"), F.avg("x2").alias("x2")).withColumn("ly", guarded_log(F.col("y")))
    return coef_out(linear.coef_table(fgls.fgls_within(df, "ly", XS, "l_suppkey", "t")))


@query(
    "m12_fit_statistics",
    """SELECT n, df AS df_resid, round(1 - rss / tss, 6) + 0.0 AS r2, round(1 - (rss / df) / (tss / n), 6) + 0.0 AS adj_r2, sq_cor
       FROM wf, (SELECT round(corr(ly, ly - u) ** 2, 6) + 0.0 AS sq_cor FROM wd)""",
    ("wf", "wd"),
)
def _(spark, sf):
    return rounded(linear.fit_statistics(within_fit(spark, sf)), "r2", "adj_r2", "sq_cor")


@query(
    "m12_poisson_statistics",
    """SELECT n, round(ll, 4) + 0.0 AS log_lik, round(-2 * ll + k * ln(n), 4) + 0.0 AS bic,
         round(1 - (ll - (k - 1)) / (sy * ln(sy / n) - sy - lf), 6) + 0.0 AS adj_pseudo_r2, round(c, 6) + 0.0 AS sq_cor FROM (
       SELECT count(*) AS n, sum(yy * ln(lam) - lam - lgamma(yy + 1)) AS ll, sum(lgamma(yy + 1)) AS lf, sum(yy) AS sy,
         2 + count(DISTINCT user_id) AS k, corr(yy, lam) ** 2 AS c FROM pqr)""",
    ("pqr",),
)
def _(spark, sf):
    out = glm.poisson_fit_statistics(poisson_fit(spark, sf))
    return rounded(rounded(out, "log_lik", "bic", digits=4), "adj_pseudo_r2", "sq_cor")


@query("m13_coef_table", coef_sql("wt", [("x1", "b1", "s2 * i11"), ("tt", "b2", "s2 * i22")]), ("wtf",))
def _(spark, sf):
    df = pb(spark, sf).withColumn("tt", F.col("t") / 100.0)
    return coef_out(linear.coef_table(linear.within(df, "ly", ["x1", "tt"], "l_suppkey")))


@query(
    "m14_model_comparison",
    """SELECT l_suppkey, round(a.fe, 6) + 0.0 AS fe_a, round(b.fe, 6) + 0.0 AS fe_b, round(a.fe - b.fe, 6) + 0.0 AS diff,
       round(abs(a.fe - b.fe), 6) + 0.0 AS abs_diff FROM wfe a JOIN wtfe b USING (l_suppkey)""",
    ("wfe", "wtfe"),
)
def _(spark, sf):
    df = pb(spark, sf).withColumn("tt", F.col("t") / 100.0)
    a = linear.within(df, "ly", XS, "l_suppkey")
    b = linear.within(df, "ly", ["x1", "tt"], "l_suppkey")
    return rounded(linear.compare_fixef(a.fixef, b.fixef, "l_suppkey"), "fe_a", "fe_b", "diff", "abs_diff")


@query(
    "f13_coefficient_difference",
    """SELECT user_id, round(a.fe - b.fe, 6) + 0.0 AS diff, round(abs(a.fe - b.fe), 6) + 0.0 AS abs_diff
       FROM pqe a JOIN pwe b USING (user_id)""",
    ("pqe", "pwe"),
)
def _(spark, sf):
    out = linear.compare_fixef(poisson_fit(spark, sf).fixef, poisson_two(spark, sf).fixef, "user_id")
    return rounded(out.select("user_id", "diff", "abs_diff"), "diff", "abs_diff")


@query(
    "m15_estimation_sample",
    """SELECT a.user_id, a.t FROM raw a JOIN raw b ON a.user_id = b.user_id AND b.t = a.t - 7
       WHERE a.y > 0 AND b.y > 0 AND a.temp IS NOT NULL""",
    ("raw",),
)
def _(spark, sf):
    df = lags.gap_aware_lags(raw(spark, sf), "user_id", "t", "y", {"lag7": 7})
    s = linear.estimation_sample(df, "y", ["temp", "lag7"], ["user_id", "t"], ["y", "lag7"])
    return s.select("user_id", "t")


# ---- residuals ----------------------------------------------------------------
@query(
    "t14_residuals",
    "SELECT l_suppkey, t, round(yy - u, 6) + 0.0 AS fitted, round(u, 6) + 0.0 AS resid FROM wd",
    ("wd",),
)
def _(spark, sf):
    out = within_fit(spark, sf).scored().select("l_suppkey", "t", "fitted", "resid")
    return rounded(out, "fitted", "resid")


@query(
    "j2_join_scores",
    "SELECT l_suppkey, t, y, round(u, 6) + 0.0 AS resid FROM wd",
    ("wd",),
)
def _(spark, sf):
    scored = within_fit(spark, sf).scored().select("l_suppkey", "t", "resid")
    panel = pb(spark, sf).select("l_suppkey", "t", "y")
    return rounded(joins.join_scores(panel, scored, ["l_suppkey", "t"]), "resid")


@query(
    "j3_join_attribute",
    "SELECT s_suppkey AS l_suppkey, s_name, round(fe, 6) + 0.0 AS fe FROM supplier LEFT JOIN wfe ON s_suppkey = l_suppkey",
    ("wfe",),
)
def _(spark, sf):
    sup = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    fe = within_fit(spark, sf).fixef.select("l_suppkey", "fe")
    return rounded(joins.join_attribute(sup, fe, "l_suppkey"), "fe")


@query(
    "o2_top_bottom",
    """SELECT * FROM (SELECT l_suppkey, round(fe, 6) + 0.0 AS fe, 'top' AS part FROM wfe ORDER BY wfe.fe DESC, l_suppkey LIMIT 5)
       UNION ALL SELECT * FROM (SELECT l_suppkey, round(fe, 6) + 0.0 AS fe, 'bottom' AS part FROM wfe ORDER BY wfe.fe, l_suppkey LIMIT 5)""",
    ("wfe",),
)
def _(spark, sf):
    from ..plans.predict import rank_effects

    fe = within_fit(spark, sf).fixef
    top = rank_effects(fe, "l_suppkey").withColumn("part", F.lit("top"))
    return rounded(top.unionByName(rank_effects(fe, "l_suppkey", top=False).withColumn("part", F.lit("bottom"))), "fe")


@query(
    "a11_residual_mean_by_category",
    "SELECT l_suppkey, CAST(month AS INTEGER) AS month, round(avg(u), 6) + 0.0 AS mean_resid FROM wd GROUP BY 1, 2",
    ("wd",),
)
def _(spark, sf):
    s = within_fit(spark, sf).scored()
    return rounded(describe.mean_by(s, ["l_suppkey", "month"], "resid", "mean_resid"), "mean_resid")


# The published rational approximation of the normal quantile, in SQL.
def _normal_quantile_sql(p: str) -> str:
    def horner(coefs, x):
        out = f"{coefs[0]!r}::DOUBLE"
        for c in coefs[1:]:
            out = f"({out} * {x} + {c!r}::DOUBLE)"
        return out

    def tail(q):
        return f"{horner(fc._ACKLAM_C, q)} / {horner(fc._ACKLAM_D, q)}"

    mid = f"({p} - 0.5::DOUBLE)"
    centre = f"{horner(fc._ACKLAM_A, f'({mid} * {mid})')} * {mid} / {horner(fc._ACKLAM_B, f'({mid} * {mid})')}"
    low, high = tail(f"sqrt(-2 * ln({p}))"), f"-({tail(f'sqrt(-2 * ln(1 - {p}))')})"
    return f"CASE WHEN {p} < 0.02425 THEN {low} WHEN {p} > 1 - 0.02425 THEN {high} ELSE {centre} END"


@query(
    "w10_qq_points",
    f"""SELECT rank, round({_normal_quantile_sql("p")}, 6) + 0.0 AS theoretical, round(u, 6) + 0.0 AS resid FROM (
          SELECT u, rank, (rank - 0.5::DOUBLE) / n AS p FROM (
            SELECT u, row_number() OVER (ORDER BY u, l_suppkey, t) AS rank, count(*) OVER () AS n FROM wd))""",
    ("wd",),
)
def _(spark, sf):
    s = within_fit(spark, sf).scored().select("l_suppkey", "t", "resid")
    out = smooth.qq_points(s, "resid", ["l_suppkey", "t"])
    return rounded(out.select("rank", "theoretical", "resid"), "theoretical", "resid")


@query(
    "w10_qq_line",
    """SELECT round((q3 - q1) / (2 * 0.6744897501960817), 6) + 0.0 AS slope, round((q1 + q3) / 2, 6) + 0.0 AS intercept FROM (
         SELECT quantile_cont(u, 0.25) AS q1, quantile_cont(u, 0.75) AS q3 FROM wd)""",
    ("wd",),
)
def _(spark, sf):
    return rounded(smooth.qq_line(within_fit(spark, sf).scored(), "resid"), "slope", "intercept")


# ---- specification tests ---------------------------------------------------------
def test_sql(stat: str, df1: str, df2: str | None, src: str) -> str:
    d2 = f"CAST({df2} AS DOUBLE)" if df2 else "CAST(NULL AS DOUBLE)"
    return f"SELECT round({stat}, 4) + 0.0 AS statistic, CAST({df1} AS DOUBLE) AS df1, {d2} AS df2 FROM {src}"


def test_out(df):
    return rounded(df.drop("p_value"), "statistic", digits=4)


F_STAT = "((r0 - r1) / (d0 - d1)) / (r1 / d1)"


def _chow_sql(p: str) -> str:
    return test_sql(F_STAT, "d0 - d1", "d1", f"(SELECT f.rss AS r0, f.df AS d0, v.rss AS r1, v.df AS d1 FROM {p}f f, (SELECT sum(rss) AS rss, sum(df) AS df FROM wv) v)")


@query("t1_chow_pooled", _chow_sql("p"), ("pf", "wv"))
def _(spark, sf):
    by = linear.ols_by_entity(pb(spark, sf), "ly", XS, "l_suppkey")
    return test_out(spec_tests.chow_poolability(pooled_fit(spark, sf), by))


@query("t2_chow_within", _chow_sql("w"), ("wf", "wv"))
def _(spark, sf):
    by = linear.ols_by_entity(pb(spark, sf), "ly", XS, "l_suppkey")
    return test_out(spec_tests.chow_poolability(within_fit(spark, sf), by))


@query(
    "t3_entity_effects_f",
    test_sql(F_STAT, "d0 - d1", "d1", "(SELECT p.rss AS r0, p.df AS d0, w.rss AS r1, w.df AS d1 FROM pf p, wf w)"),
    ("pf", "wf"),
)
def _(spark, sf):
    return test_out(spec_tests.f_test_nested(pooled_fit(spark, sf), within_fit(spark, sf)))


@query(
    "t4_nested_within_f",
    test_sql(F_STAT, "d0 - d1", "d1", "(SELECT tss - p * p / a AS r0, df + 1 AS d0, rss AS r1, df AS d1 FROM wtf)"),
    ("wtf",),
)
def _(spark, sf):
    df = pb(spark, sf).withColumn("tt", F.col("t") / 100.0)
    small = linear.within(df, "ly", ["x1"], "l_suppkey")
    return test_out(spec_tests.f_test_nested(small, linear.within(df, "ly", ["x1", "tt"], "l_suppkey")))


cte(
    "psum",
    """SELECT sum(su * su) AS u2, sum(uu) AS uu, sum(n) AS nn, sum(n * n) AS t2, count(*) AS g, sum((su * su - uu) / 2) AS w,
         sum(((su * su - uu) / 2) ** 2) AS w2 FROM (
       SELECT l_suppkey, sum(u) AS su, sum(u * u) AS uu, CAST(count(*) AS DOUBLE) AS n FROM pd GROUP BY 1)""",
    ("pd",),
)


@query("t5_breusch_pagan_lm", test_sql("nn * nn / 2 * (1 - u2 / uu) ** 2 / (t2 - nn)", "1", None, "psum"), ("psum",))
def _(spark, sf):
    return test_out(spec_tests.breusch_pagan_lm(pooled_fit(spark, sf), "l_suppkey"))


@query("t6_wooldridge_effects", test_sql("w / sqrt(w2)", "1", None, "psum"), ("psum",))
def _(spark, sf):
    return test_out(spec_tests.wooldridge_effects(pooled_fit(spark, sf), "l_suppkey"))


@query(
    "t7_locally_robust_ar1",
    test_sql(
        "nn * nn * (b + c * a) ** 2 / (p * (1 - 2 * c))", "1", None,
        """(SELECT nn, p, 1 - u2 / uu AS a, x / uu AS b, p / (t2 - nn) AS c FROM psum, (SELECT sum(r.u * l.u) AS x, CAST(count(*) AS DOUBLE) AS p
            FROM pd r JOIN pd l ON r.l_suppkey = l.l_suppkey AND l.t = r.t - 1))""",
    ),
    ("psum", "pd"),
)
def _(spark, sf):
    return test_out(spec_tests.locally_robust_ar1(pooled_fit(spark, sf), "l_suppkey", "t"))


cte(
    "arx",
    "SELECT r.l_suppkey, r.u, l.u AS x, l.u * l.u AS xq FROM wd r JOIN wd l ON r.l_suppkey = l.l_suppkey AND l.t = r.t - 1",
    ("wd",),
)
cte("ar7", "SELECT r.l_suppkey, r.u, l.u AS x, l.u * l.u AS xq FROM wd r JOIN wd l ON r.l_suppkey = l.l_suppkey AND l.t = r.t - 7", ("wd",))
linear_ctes("aq", "ar7", "u", "x", "xq", None)
cte(
    "arf",
    """SELECT *, my - b * mx AS b0, (syy - b * sxy) / (n - 2) / sxx AS var_b FROM (
         SELECT count(*) AS n, avg(x) AS mx, avg(u) AS my, regr_slope(u, x) AS b, regr_sxx(u, x) AS sxx, regr_sxy(u, x) AS sxy, regr_syy(u, x) AS syy FROM arx)""",
    ("arx",),
)


@query(
    "t8_wooldridge_ar1",
    test_sql(
        "((b - delta) / sqrt(meat) * sxx) ** 2", "1", "g - 1",
        """(SELECT b, sxx, -1 / (CAST(w.n AS DOUBLE) / g - 1) AS delta, g, meat FROM arf, (SELECT n, g FROM wf) w, (SELECT sum(s * s) AS meat FROM (
            SELECT l_suppkey, sum((x - mx) * (u - b0 - b * x)) AS s FROM arx, arf GROUP BY 1)))""",
    ),
    ("arf", "wf", "arx"),
)
def _(spark, sf):
    return test_out(spec_tests.wooldridge_ar1(within_fit(spark, sf), "t"))


@query(
    "t9_manual_ar1",
    test_sql("(delta - b) / sqrt(var_b)", "arf.n - 2", None, "arf, (SELECT -1 / (CAST(n AS DOUBLE) / g - 1) AS delta FROM wf)"),
    ("arf", "wf"),
)
def _(spark, sf):
    return test_out(spec_tests.manual_ar_check(within_fit(spark, sf), "t", 1))


@query(
    "t9_manual_ar7_square",
    test_sql("(-1.0::DOUBLE / 333 - b1) / sqrt(s2 * i11)", "df", None, "aqf"),
    ("aqf",),
)
def _(spark, sf):
    return test_out(spec_tests.manual_ar_check(within_fit(spark, sf), "t", 7, True, -1 / 333))


@query(
    "t10_breusch_godfrey",
    # residuals are orthogonal to d1 and d2, so only the lag has a right-hand side
    test_sql(
        "n * r * r * (a * c - b * b) / (a * (c * e - q * q) - b * (b * e - q * p) + p * (b * q - c * p)) / uu", "1", None,
        """(SELECT count(*) AS n, sum(r.d1 * r.d1) AS a, sum(r.d1 * r.d2) AS b, sum(r.d2 * r.d2) AS c, sum(r.d1 * coalesce(l.u, 0)) AS p,
            sum(r.d2 * coalesce(l.u, 0)) AS q, sum(coalesce(l.u, 0) ** 2) AS e, sum(r.u * coalesce(l.u, 0)) AS r, sum(r.u * r.u) AS uu
            FROM wd r LEFT JOIN wd l ON r.l_suppkey = l.l_suppkey AND l.t = r.t - 1)""",
    ),
    ("wd",),
)
def _(spark, sf):
    return test_out(spec_tests.breusch_godfrey(within_fit(spark, sf), "t", 1))


cte("bgo", "SELECT min(n) AS k FROM (SELECT count(*) AS n FROM wd GROUP BY l_suppkey)", ("wd",))
cte("bgr", "SELECT l_suppkey, t, d1, d2, u FROM wd", ("wd",))
# the columns of a row: the covariates, the lags that have a row, the residual
cte(
    "bgz",
    """SELECT l_suppkey, t, 1 AS j, d1 AS v FROM bgr UNION ALL SELECT l_suppkey, t, 2, d2 FROM bgr
       UNION ALL SELECT r.l_suppkey, r.t, 2 + r.t - l.t, l.u FROM bgr r JOIN bgr l ON r.l_suppkey = l.l_suppkey AND l.t < r.t, bgo WHERE r.t - l.t <= k
       UNION ALL SELECT l_suppkey, t, 3 + k, u FROM bgr, bgo""",
    ("bgr", "bgo"),
)
cte("bgc", "SELECT a.j AS i, b.j, sum(a.v * b.v) AS v FROM bgz a JOIN bgz b USING (l_suppkey, t) GROUP BY ALL", ("bgz",))
cte(
    "bgm",
    """SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(coalesce(v, 0) ORDER BY j) AS r FROM
         (SELECT i, unnest(range(1, k + 4)) AS j FROM (SELECT k, unnest(range(1, k + 4)) AS i FROM bgo)) LEFT JOIN bgc USING (i, j) GROUP BY i)""",
    ("bgc", "bgo"),
)
# what is left of the residual's square once all other columns are eliminated, first column first
cte(
    "bge",
    """SELECT m FROM bgm UNION ALL SELECT list_transform(m[2:], lambda r: list_transform(r[2:], lambda v, j: v - r[1] * m[1][j + 1] / m[1][1]))
       FROM bge WHERE len(m) > 1""",
    ("bgm",),
)


@query(
    "t10_breusch_godfrey_default_order",
    test_sql("n * (1 - e.m[1][1] / uu)", "k", None, "(SELECT count(*) AS n, sum(u * u) AS uu FROM bgr), bgo, bge e WHERE len(e.m) = 1"),
    ("bgr", "bgo", "bge"),
)
def _(spark, sf):
    return test_out(spec_tests.breusch_godfrey(within_fit(spark, sf), "t"))


# ---- robust covariances --------------------------------------------------------
def _sandwich_sql(meat: str, p: str = "w", inv=("i11", "i12", "i22"), factor: str = "1") -> str:
    """Coefficient table with the sandwich of an inverse and a 2 x 2 meat m11, m12, m22."""
    a, b, c = inv
    v1 = f"{factor} * ({a} * {a} * m11 + 2 * {a} * {b} * m12 + {b} * {b} * m22)"
    v2 = f"{factor} * ({b} * {b} * m11 + 2 * {b} * {c} * m12 + {c} * {c} * m22)"
    return " UNION ALL ".join(
        f"SELECT '{{{i}}}' AS term, round(b{i + 1}, 6) + 0.0 AS estimate, round(sqrt({v}), 6) + 0.0 AS std_error FROM {p}f, ({meat}) meat"
        for i, v in enumerate((v1, v2))
    )


def robust_out(fit, v):
    out = linear.coef_table(fit, v).select("term", "estimate", "std_error")
    return rounded(out, "estimate", "std_error")


@query(
    "t11_vcov_arellano",
    _sandwich_sql(
        "SELECT sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22 FROM (SELECT sum(d1 * u) AS s1, sum(d2 * u) AS s2 FROM wd GROUP BY l_suppkey)"
    ).format(*XS),
    ("wf", "wd"),
)
def _(spark, sf):
    fit = within_fit(spark, sf)
    return robust_out(fit, robust.vcov_arellano(fit))


@query(
    "t12_vcov_white2_hc3",
    _sandwich_sql(
        """SELECT sum(s * a) AS m11, sum(s * b) AS m12, sum(s * c) AS m22 FROM (
             SELECT avg((u / (1 - d1 * d1 * i11 - 2 * d1 * d2 * i12 - d2 * d2 * i22)) ** 2) AS s, sum(d1 * d1) AS a, sum(d1 * d2) AS b, sum(d2 * d2) AS c
             FROM wd, (SELECT i11, i12, i22 FROM wf) GROUP BY l_suppkey)"""
    ).format(*XS),
    ("wf", "wd"),
)
def _(spark, sf):
    fit = within_fit(spark, sf)
    return robust_out(fit, robust.vcov_white2_hc3(fit))


def _meat_sql(by: str, p: str) -> str:
    return f"""SELECT sum(s1 * s1) AS m11, sum(s1 * s2) AS m12, sum(s2 * s2) AS m22, CAST(count(*) AS DOUBLE) AS g
      FROM (SELECT sum(sc1) AS s1, sum(sc2) AS s2 FROM {p}r GROUP BY {by})"""


_INV = ("v11", "v12", "v22")
_N = "(SELECT count(*) FROM {p}r)"


@query(
    "t13_poisson_cluster_one_way",
    _sandwich_sql(_meat_sql("user_id", "pq"), "pq", _INV, f"g / (g - 1) * (({_N} - 1) / ({_N} - 3.0::DOUBLE))".replace("{p}", "pq")).format("xs", "rain"),
    ("pqf", "pqr"),
)
def _(spark, sf):
    fit = poisson_fit(spark, sf)
    return robust_out(fit, robust.vcov_poisson_cluster(fit, ["user_id"]))


@query(
    "t13_poisson_cluster_two_way",
    _sandwich_sql(
        f"""SELECT a.m11 + b.m11 - c.m11 AS m11, a.m12 + b.m12 - c.m12 AS m12, a.m22 + b.m22 - c.m22 AS m22, least(a.g, b.g) AS g
            FROM ({_meat_sql('user_id', 'pq')}) a, ({_meat_sql('t', 'pq')}) b, ({_meat_sql('user_id, t', 'pq')}) c""",
        "pq", _INV, f"g / (g - 1) * (({_N} - 1) / ({_N} - 3.0::DOUBLE))".replace("{p}", "pq"),
    ).format("xs", "rain"),
    ("pqf", "pqr"),
)
def _(spark, sf):
    fit = poisson_fit(spark, sf)
    return robust_out(fit, robust.vcov_poisson_cluster(fit, ["user_id", "t"]))


# ---- residual views -----------------------------------------------------------
NINE_PB = """SELECT l_suppkey FROM (SELECT l_suppkey, row_number() OVER (ORDER BY m, l_suppkey) AS r, count(*) OVER () AS n
  FROM (SELECT l_suppkey, avg(y) AS m FROM pb GROUP BY 1)) WHERE r <= 3 OR r BETWEEN n // 2 - 1 AND n // 2 + 1 OR r > n - 3"""


def _ks_sql(src: str, x: str, y: str, bw: float, keys: str) -> str:
    return f"""SELECT {", ".join("g." + k for k in keys.split(", "))}, g.point, round(g.x0, 5) + 0.0 AS x0, round(sum(CASE WHEN abs(r.{x} - g.x0) <= 4 * sd THEN
        exp(-0.5 * ((r.{x} - g.x0) / sd) ** 2) * {y} END) / sum(CASE WHEN abs(r.{x} - g.x0) <= 4 * sd THEN exp(-0.5 * ((r.{x} - g.x0) / sd) ** 2) END), 5) + 0.0 AS y_hat
      FROM (SELECT {keys}, i AS point, a + i * ((b - a) / 99) AS x0, 0.25 / 0.6744897501960817 * {bw} AS sd FROM
        (SELECT {keys}, min({x}) AS a, max({x}) AS b FROM {src} GROUP BY ALL), (SELECT unnest(generate_series(0, 99)) AS i)) g
      JOIN {src} r USING ({keys}) GROUP BY ALL"""


cte("ninepb", NINE_PB, ("pb",))
cte("t15", "SELECT l_suppkey, yy - u AS f, exp(u) AS e FROM wd WHERE l_suppkey IN (SELECT l_suppkey FROM ninepb)", ("wd", "ninepb"))
cte(
    "t16",
    """SELECT l_suppkey, 'x1' AS covariate, x1 AS x, u FROM wd WHERE l_suppkey IN (SELECT l_suppkey FROM ninepb)
       UNION ALL SELECT l_suppkey, 'x2', x2, u FROM wd WHERE l_suppkey IN (SELECT l_suppkey FROM ninepb)""",
    ("wd", "ninepb"),
)


def nine_scored(spark, sf):
    s = within_fit(spark, sf).scored()
    nine = ranking.pick_bottom_middle_top(ranking.rank_entities(pb(spark, sf), "l_suppkey", "y"))
    return joins.rows_of_entities(s, nine, "l_suppkey")


@query("t15_heteroscedasticity", _ks_sql("t15", "f", "e", 1.0, "l_suppkey"), ("t15",))
def _(spark, sf):
    s = nine_scored(spark, sf).withColumn("e", F.exp("resid"))
    return rounded(smooth.kernel_smooth(s, "fitted", "e", 1.0, ["l_suppkey"]), "x0", "y_hat", digits=5)


@query("t16_residual_vs_covariates", _ks_sql("t16", "x", "u", 0.5, "l_suppkey, covariate"), ("t16",))
def _(spark, sf):
    out = smooth.residual_smooths(nine_scored(spark, sf), "l_suppkey", "resid", XS, 0.5)
    return rounded(out, "x0", "y_hat", digits=5)


def _resid_ma(w: int) -> str:
    frame = f"OVER (PARTITION BY l_suppkey ORDER BY t ROWS BETWEEN {(w - 1) // 2} PRECEDING AND {w // 2} FOLLOWING)"
    return f"round(CASE WHEN count(u) {frame} = {w} THEN avg(u) {frame} END, 6) + 0.0 AS ma{w}"


@query("t17_residual_moving_average", f"SELECT l_suppkey, t, {_resid_ma(7)}, {_resid_ma(30)} FROM wd", ("wd",))
def _(spark, sf):
    s = within_fit(spark, sf).scored().select("l_suppkey", "t", "resid")
    out = smooth.moving_average(s, "l_suppkey", "t", "resid", {"ma7": 7, "ma30": 30})
    return rounded(out.drop("resid"), "ma7", "ma30")


lowess_ctes("tl", "wd", "l_suppkey", "u")


@query("t17_residual_lowess", "SELECT l_suppkey, t, i AS pos, round(y, 5) + 0.0 AS y, round(fit, 5) + 0.0 AS trend FROM tlf3", ("tlf3",))
def _(spark, sf):
    s = within_fit(spark, sf).scored().select("l_suppkey", "t", "resid")
    out = longs(smooth.lowess(s, "l_suppkey", "t", "resid"), "pos")
    return rounded(out, "y", "trend", digits=5)
