"""Imputation, prediction, scenario and ranking queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dist
from ..functions.columns import guarded_log, hash_uniform, poisson_draw
from ..models import glm, linear
from ..operators import joins, lags, ranking, smooth
from ..plans import impute, predict
from ..session import delete_on_exit, scratch_root
from ..sources.panels import read_panel_csv, write_panel
from .base import cte, pa, pa_cells, pa_days, pb, query, rounded
from .model_sql import linear_ctes, poisson_ctes
from .modelling import coef_out, coef_sql, pap, poisson_fit, within_fit

FIRST, LAST = 15, 28  # the period to impute, two weekly waves


# ---- CSV sink and source ------------------------------------------------------
CELL_SCHEMA = T.StructType(
    [T.StructField("user_id", T.LongType()), T.StructField("d", T.DateType()), T.StructField("y", T.LongType())]
)


def _round_trip(spark, df, schema, **kw):
    """Write CSV to a new folder in the shared scratch area and read it back."""
    path = f"{scratch_root(spark)}/panel-{uuid.uuid4().hex}"
    write_panel(df, path, "csv", **kw)
    delete_on_exit(spark, path)
    return read_panel_csv(spark, path, schema)


@query("s1_read_panel_csv", "SELECT user_id, d, CASE WHEN y <> 2 THEN y END AS y FROM cells", ("cells",))
def _(spark, sf):
    df = pa_cells(spark, sf).select("d", F.when(F.col("y") != 2, F.col("y")).alias("y"), "user_id")
    return _round_trip(spark, df, CELL_SCHEMA)


@query("s3_write_panel", "SELECT user_id, d, y FROM cells", ("cells",))
def _(spark, sf):
    path = f"{scratch_root(spark)}/panel-{uuid.uuid4().hex}"
    df = pa_cells(spark, sf).select("user_id", "d", "y")
    write_panel(df.withColumn("week", F.weekofyear("d")), path, "parquet", partition_by=["week"])
    delete_on_exit(spark, path)
    return spark.read.parquet(path).drop("week")


# ---- period and effects -------------------------------------------------------
@query("i1_exclude_period", f"SELECT user_id, t, y FROM pa WHERE NOT (t BETWEEN {FIRST} AND {LAST})", ("pa",))
def _(spark, sf):
    return impute.exclude_period(pa(spark, sf), "t", FIRST, LAST).select("user_id", "t", "y")


@query("i1_mark_period", f"SELECT user_id, t, t BETWEEN {FIRST} AND {LAST} AS in_period FROM pa", ("pa",))
def _(spark, sf):
    return impute.mark_period(pa(spark, sf), "t", FIRST, LAST).select("user_id", "t", "in_period")


SPLINE_MONTHS = [1, 2, 3, 4, 5, 6, 7, 9, 10, 11]


def _spline_weights() -> str:
    """Effect of each knot value on each day: the spline is linear in the knot values.

    Found from the defining equations of all pieces at once (values, first and
    second derivatives, end conditions), not with the recursion of the package.
    """
    import numpy as np

    x = np.array([m + 0.5 for m in SPLINE_MONTHS])
    n, p = len(x), len(x) - 1
    rows, rhs = [], []

    def put(entries, right):
        r = np.zeros(4 * p)
        for i, v in entries:
            r[i] += v
        rows.append(r)
        rhs.append(right)

    unit, h = np.eye(n), np.diff(x)
    zero = np.zeros(n)
    for i in range(p):
        put([(4 * i, 1)], unit[i])
        put([(4 * i + k, h[i] ** k) for k in range(4)], unit[i + 1])
        if i < p - 1:
            put([(4 * i + k, k * h[i] ** (k - 1)) for k in (1, 2, 3)] + [(4 * i + 5, -1)], zero)
            put([(4 * i + 2, 2), (4 * i + 3, 6 * h[i]), (4 * i + 6, -2)], zero)
    for piece, knots in ((0, slice(0, 4)), (p - 1, slice(n - 4, n))):
        cubic = np.linalg.inv(np.vander(x[knots], 4))[0]  # weights of the leading coefficient
        right = np.zeros(n)
        right[knots] = cubic
        put([(4 * piece + 3, 1)], right)
    w = np.linalg.solve(np.array(rows), np.array(rhs))
    grid = np.linspace(x[0], x[-1], 31 * n)
    out = []
    for day, g in enumerate(grid[(grid > 8) & (grid < 9)], start=1):
        i = int(np.searchsorted(x, g)) - 1
        eff = sum((g - x[i]) ** k * w[4 * i + k] for k in range(4))
        out += [f"({day}, {m}, {v!r}::DOUBLE)" for m, v in zip(SPLINE_MONTHS, map(float, eff))]
    return ", ".join(out)


@query(
    "i2_month_spline",
    f"""SELECT CAST(day AS INTEGER) AS day, round(sum(w * e), 6) + 0.0 AS effect FROM (VALUES {_spline_weights()}) v(day, month, w)
        JOIN (SELECT month, ln(avg(y)) AS e FROM pb GROUP BY 1) USING (month) GROUP BY 1""",
    ("pb",),
)
def _(spark, sf):
    means = pb(spark, sf).groupBy("month").agg(F.ln(F.avg("y")).alias("e"))  # twelve rows
    effects = {r["month"]: r["e"] for r in means.filter(F.col("month").isin(SPLINE_MONTHS)).collect()}
    out = smooth.month_effect_spline(spark, effects, 8)
    return rounded(out.select("day", "effect"), "effect")


# ---- recursive imputation -------------------------------------------------------
cte("nop", f"SELECT * FROM pa WHERE NOT (t BETWEEN {FIRST} AND {LAST})", ("pa",))
cte("nol", "SELECT a.*, b.y AS lag7 FROM nop a JOIN nop b ON a.user_id = b.user_id AND b.t = a.t - 7", ("nop",))
poisson_ctes("im", "nol", "y", "rain", "lag7", "user_id")
cte("eday", f"SELECT t, rain, CASE WHEN t BETWEEN {FIRST} AND {LAST} THEN 0.02::DOUBLE * (t - {FIRST}) ELSE 0.05::DOUBLE END AS eff FROM days", ("days",))


def imputation_inputs(spark, sf):
    panel = pa(spark, sf)
    clean = impute.exclude_period(panel, "t", FIRST, LAST)
    clean = lags.gap_aware_lags(clean, "user_id", "t", "y", {"lag7": 7})
    fit = glm.poisson_fe(clean, "y", ["rain", "lag7"], "user_id", keys=["t"])
    b = fit.slopes
    model = impute.CountModel({"rain": b["rain"]}, b["lag7"], fit.fixef)
    t = F.col("t")
    days = pa_days(spark, sf).withColumn(
        "effect", F.when(t.between(FIRST, LAST), 0.02 * (t - FIRST)).otherwise(0.05)
    )
    return panel, days, model


def imputed(spark, sf, draw="expected"):
    panel, days, model = imputation_inputs(spark, sf)
    out, rejected = impute.impute_period(panel, days, model, "user_id", "t", "y", FIRST, LAST, draw=draw, seed=1)
    return panel, out, rejected


def _draw_ctes(name: str, src: str, kind: str) -> None:
    """Poisson inverse distribution function at the hashed uniform, by enumeration."""
    cte(
        f"{name}",
        f"""SELECT user_id, t, CAST(count(CASE WHEN cdf < u THEN 1 END) AS DOUBLE) AS k FROM (
              SELECT user_id, t, u, sum(exp(-lam + k * ln(lam) - lgamma(k + 1))) OVER (PARTITION BY user_id, t ORDER BY k) AS cdf FROM (
                SELECT user_id, t, lam, CAST(('0x' || substr(md5(concat_ws('|', user_id, t, 1, '{kind}')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
                FROM {src} WHERE lam IS NOT NULL), (SELECT unnest(generate_series(0, 80)) AS k)) GROUP BY 1, 2""",
        (src,),
    )


def _wave_ctes(p: str, poisson: bool) -> None:
    cte(f"{p}s0", f"SELECT user_id, t, CAST(y AS DOUBLE) AS y FROM pa WHERE t < {FIRST}", ("pa",))
    for w in (1, 2):
        lo = FIRST + 7 * (w - 1)
        st = f"{p}s{w - 1}"
        lam = lambda shift, lag: (
            f"(SELECT exp(b1 * d.rain + d.eff + e.fe + b2 * {lag}) FROM imf, eday d WHERE d.t = r.t - {shift})"
        )
        cte(
            f"{p}c{w}",
            f"""SELECT p.user_id, p.t, c1.y AS c1, c2.y AS c2, c3.y AS c3 FROM pa p
                LEFT JOIN {st} c1 ON c1.user_id = p.user_id AND c1.t = p.t - 7 LEFT JOIN {st} c2 ON c2.user_id = p.user_id AND c2.t = p.t - 14
                LEFT JOIN {st} c3 ON c3.user_id = p.user_id AND c3.t = p.t - 21 WHERE p.t BETWEEN {lo} AND {lo + 6}""",
            ("pa", st),
        )
        prev = f"{p}c{w}"
        for step, kind, shift, cond, lag, keep in (
            ("m2", "back2", 14, "c1 IS NULL AND c2 IS NULL", "c3", "c2"),
            ("m1", "back1", 7, "c1 IS NULL", "f2", "c1"),
            ("l", "day", 0, "TRUE", "f1", "NULL"),
        ):
            cte(
                f"{p}{step}{w}",
                f"SELECT r.*, r.lamx AS lam FROM (SELECT r.*, CASE WHEN {cond} THEN {lam(shift, lag)} END AS lamx FROM {prev} r LEFT JOIN ime e USING (user_id)) r",
                (prev, "ime", "imf", "eday"),
            )
            new = {"m2": "f2", "m1": "f1", "l": "yi"}[step]
            if poisson:
                _draw_ctes(f"{p}{step}d{w}", f"{p}{step}{w}", kind)
                body = f"SELECT r.* EXCLUDE (lamx, lam), lam AS lam_{step}, coalesce({keep}, k) AS {new} FROM {p}{step}{w} r LEFT JOIN {p}{step}d{w} USING (user_id, t)"
                needs = (f"{p}{step}{w}", f"{p}{step}d{w}")
            else:
                body = f"SELECT * EXCLUDE (lamx, lam), lam AS lam_{step}, coalesce({keep}, lam) AS {new} FROM {p}{step}{w}"
                needs = (f"{p}{step}{w}",)
            prev = f"{p}{step}f{w}"
            cte(prev, body, needs)
        cte(f"{p}s{w}", f"SELECT * FROM {st} UNION ALL SELECT user_id, t, yi FROM {prev}", (st, prev))
    cte(f"{p}out", f"SELECT user_id, t, lam_l AS lam, yi FROM {p}lf1 UNION ALL SELECT user_id, t, lam_l, yi FROM {p}lf2", (f"{p}lf1", f"{p}lf2"))


_wave_ctes("we", False)
_wave_ctes("wp", True)


def known_counts(panel, out):
    """(user_id, t) of the days with a count, observed before the period or imputed within."""
    return panel.filter(F.col("t") < FIRST).select("user_id", "t").union(out.select("user_id", "t"))


def days_later(known, k):
    return known.select("user_id", (F.col("t") + k).alias("t"))


cte("wave_rows", "SELECT user_id, t, c1, c2, lam_l FROM welf1 UNION ALL SELECT user_id, t, c1, c2, lam_l FROM welf2", ("welf1", "welf2"))


@query(
    "i3_lambda_prediction",
    "SELECT user_id, t, round(lam_l, 6) + 0.0 AS lambda FROM wave_rows WHERE c1 IS NOT NULL AND lam_l IS NOT NULL",
    ("wave_rows",),
)
def _(spark, sf):
    """All waves: means of the days with a count one week ago, which from the second wave on is an imputed one."""
    panel, out, _ = imputed(spark, sf)
    out = out.join(days_later(known_counts(panel, out), 7), ["user_id", "t"], "left_semi")
    return rounded(out.select("user_id", "t", "lambda"), "lambda")


@query("i4_impute_expected", "SELECT user_id, t, round(lam, 5) + 0.0 AS lambda, round(yi, 5) + 0.0 AS y_imputed FROM weout WHERE lam IS NOT NULL", ("weout",))
def _(spark, sf):
    return rounded(imputed(spark, sf)[1], "lambda", "y_imputed", digits=5)


@query("i4_impute_poisson", "SELECT user_id, t, round(lam, 5) + 0.0 AS lambda, yi AS y_imputed FROM wpout WHERE lam IS NOT NULL", ("wpout",))
def _(spark, sf):
    return rounded(imputed(spark, sf, "poisson")[1], "lambda", digits=5)


@query(
    "i5_fallback_one_week",
    "SELECT user_id, t, round(lam_l, 5) + 0.0 AS lambda FROM wave_rows WHERE c1 IS NULL AND c2 IS NOT NULL AND lam_l IS NOT NULL",
    ("wave_rows",),
)
def _(spark, sf):
    """All waves: days without a count one week ago but with one two weeks ago."""
    panel, out, _ = imputed(spark, sf)
    known = known_counts(panel, out)
    out = out.join(days_later(known, 7), ["user_id", "t"], "left_anti").join(days_later(known, 14), ["user_id", "t"], "left_semi")
    return rounded(out.select("user_id", "t", "lambda"), "lambda", digits=5)


@query("i6_reject_rows", "SELECT user_id, t FROM weout WHERE lam IS NULL", ("weout",))
def _(spark, sf):
    return imputed(spark, sf)[2]


cte("i7src", "SELECT user_id, t, CAST(y AS DOUBLE) AS lam FROM pa", ("pa",))
_draw_ctes("i7d", "i7src", "day")


@query(
    "i7_poisson_draw_large",
    """SELECT user_id, t, CAST(k0 + CASE WHEN n % 2 = 1 THEN (n + 1) // 2 ELSE -(n // 2) END AS BIGINT) AS k FROM (
         SELECT user_id, t, k0, count(CASE WHEN cdf < u THEN 1 END) AS n FROM (
           SELECT user_id, t, k0, u, sum(exp(-lam + k * ln(lam) - lgamma(k + 1))) OVER (PARTITION BY user_id, t ORDER BY j) AS cdf FROM (
             SELECT user_id, t, lam, j, floor(lam) AS k0, floor(lam) + CASE WHEN j % 2 = 1 THEN (j + 1) // 2 ELSE -(j // 2) END AS k,
               CAST(('0x' || substr(md5(concat_ws('|', user_id, t, 1, 'large')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
             FROM (SELECT user_id, t, y * 100.0::DOUBLE + 700.5::DOUBLE AS lam FROM pa), (SELECT unnest(generate_series(0, 1100)) AS j)))
         GROUP BY 1, 2, 3)""",
    ("pa",),
)
def _(spark, sf):
    df = pa(spark, sf).select("user_id", "t", (F.col("y") * 100.0 + 700.5).alias("lam"))
    u = hash_uniform(F.col("user_id"), F.col("t"), F.lit(1), F.lit("large"))
    return df.select("user_id", "t", poisson_draw(F.col("lam"), u).alias("k"))


@query("i7_poisson_draw", "SELECT user_id, t, CAST(k AS BIGINT) AS k FROM i7d", ("i7d",))
def _(spark, sf):
    df = pa(spark, sf).select("user_id", "t", F.col("y").cast("double").alias("lam"))
    u = hash_uniform(F.col("user_id"), F.col("t"), F.lit(1), F.lit("day"))
    return df.select("user_id", "t", poisson_draw(F.col("lam"), u).alias("k"))


cte(
    "newpa",
    """SELECT p.user_id, p.t, p.y AS y_raw, coalesce(o.yi, CAST(p.y AS DOUBLE)) AS y, o.yi IS NOT NULL AS is_imputed, p.rain, p.x / 100 AS xs
       FROM pa p LEFT JOIN weout o ON o.user_id = p.user_id AND o.t = p.t WHERE o.user_id IS NULL OR o.lam IS NOT NULL""",
    ("pa", "weout"),
)


@query(
    "i8_before_after",
    """SELECT user_id, is_imputed, round(avg(y_raw), 5) + 0.0 AS mean_raw, round(avg(y), 5) + 0.0 AS mean_imputed, count(*) AS n
       FROM newpa WHERE user_id IN (SELECT user_id FROM spaced) GROUP BY 1, 2""",
    ("newpa", "spaced"),
)
def _(spark, sf):
    panel, out, rejected = imputed(spark, sf)
    new = impute.apply_imputation(panel, out, "user_id", "t", "y", rejected)
    chosen = ranking.sample_entities(panel, "user_id", 9)
    res = impute.compare_periods(panel, joins.rows_of_entities(new, chosen, "user_id"), "user_id", "t", "y")
    return rounded(res, "mean_raw", "mean_imputed", digits=5)


cte("newly", "SELECT *, ln(y) AS ly FROM newpa", ("newpa",))
linear_ctes("rf", "newly", "ly", "xs", "rain", "user_id")


@query("i9_refit", coef_sql("rf", [("xs", "b1", "s2 * i11"), ("rain", "b2", "s2 * i22")]), ("rff",))
def _(spark, sf):
    panel, out, rejected = imputed(spark, sf)
    new = impute.apply_imputation(panel, out, "user_id", "t", "y", rejected)
    new = new.withColumns({"ly": guarded_log(F.col("y")), "xs": F.col("x") / 100})
    return coef_out(linear.coef_table(linear.within(new, "ly", ["xs", "rain"], "user_id")))


# ---- prediction ----------------------------------------------------------------
@query("i10_smearing_global", "SELECT round(avg(exp(u)), 6) + 0.0 AS smearing FROM wd", ("wd",))
def _(spark, sf):
    return rounded(predict.smearing_factor(within_fit(spark, sf)), "smearing")


@query("i10_smearing_by_entity", "SELECT l_suppkey, round(avg(exp(u)), 6) + 0.0 AS smearing FROM wd GROUP BY 1", ("wd",))
def _(spark, sf):
    return rounded(predict.smearing_factor(within_fit(spark, sf), True), "smearing")


@query(
    "i11_smeared_prediction",
    "SELECT l_suppkey, t, round(exp(yy - u) * (SELECT avg(exp(u)) FROM wd), 5) + 0.0 AS prediction FROM wd",
    ("wd",),
)
def _(spark, sf):
    df = pb(spark, sf).select("l_suppkey", "t", "x1", "x2")
    out = predict.predict_smeared(df, within_fit(spark, sf))
    return rounded(out.select("l_suppkey", "t", "prediction"), "prediction", digits=5)


@query("i12_poisson_prediction", "SELECT user_id, t, round(lam, 5) + 0.0 AS prediction FROM pqr", ("pqr",))
def _(spark, sf):
    out = predict.predict_poisson(pap(spark, sf).select("user_id", "t", "xs", "rain"), poisson_fit(spark, sf))
    return rounded(out.select("user_id", "t", "prediction"), "prediction", digits=5)


def _t_values(alpha: float = 0.05, last: int = 120) -> str:
    return ", ".join(f"({d}, {dist.t_quantile(1 - alpha / 2, d)!r}::DOUBLE)" for d in range(1, last))


cte(
    "ivp",
    f"""SELECT l_suppkey, count(*) AS n_i, avg(u * u) AS s2_i, avg(exp(u)) AS al_i, max(tq) AS tq FROM wd JOIN (
          SELECT l_suppkey, tq FROM (SELECT l_suppkey, count(*) - 3 AS df FROM wd GROUP BY 1) JOIN (VALUES {_t_values()}) v(df, tq) USING (df))
        USING (l_suppkey) GROUP BY 1""",
    ("wd",),
)
cte("iva", "SELECT avg(u * u) AS s2_all, avg(exp(u)) AS al_all FROM wd", ("wd",))


def _interval_sql(src: str, keys: str, var: str, al: str, cols: str) -> str:
    return f"""SELECT {keys}, {cols} FROM (SELECT *, {al} * exp(b1 * x1 + b2 * x2 + fe) AS pred, tq * sqrt({var}) AS half FROM (
      SELECT r.*, f.b1, f.b2, fe.fe, s2_i, al_i, tq, s2_all, al_all, f.s2 * (r.x1 * r.x1 * f.i11 + 2 * r.x1 * r.x2 * f.i12 + r.x2 * r.x2 * f.i22) AS q
      FROM {src} r JOIN wfe fe USING (l_suppkey) JOIN ivp USING (l_suppkey), wf f, iva))"""


_BOUNDS = "round(pred, 4) + 0.0 AS prediction, round(exp(ln(pred) - half), 4) + 0.0 AS lower, round(exp(ln(pred) + half), 4) + 0.0 AS upper"
_IV = ("pb", "wfe", "ivp", "wf", "iva")


def _interval_query(key: str, var: str, al: str, **kw) -> None:
    @query(key, _interval_sql("pb", "l_suppkey, t", var, al, _BOUNDS), _IV)
    def _(spark, sf):
        df = pb(spark, sf).select("l_suppkey", "t", "x1", "x2")
        out = predict.interval(df, within_fit(spark, sf), **kw)
        return rounded(out.select("l_suppkey", "t", "prediction", "lower", "upper"), "prediction", "lower", "upper", digits=4)


_interval_query("i13_interval_prediction", "q", "al_all")
_interval_query("i13_interval_prediction_specific", "q", "al_i", sigma="specific", smearing="specific")
_interval_query("i13_interval_forecast", "s2_all + q", "al_all", type="forecast")
_interval_query("i13_interval_forecast_specific", "s2_i + q", "al_i", type="forecast", sigma="specific", smearing="specific")

cte("tmpl", "SELECT l_suppkey, avg(x1) AS x1 FROM pb WHERE month = 8 GROUP BY 1", ("pb",))
cte("sweep", "SELECT l_suppkey, x1, 1.0::DOUBLE + i * (4.0::DOUBLE / 639.0) AS x2 FROM tmpl, (SELECT unnest(generate_series(0, 639)) AS i)", ("tmpl",))


@query(
    "i15_scenario_sweep",
    f"""SELECT a.l_suppkey, round(a.x2, 6) + 0.0 AS x2, prediction, lower, upper, lower_forecast, upper_forecast FROM (
        {_interval_sql("sweep", "l_suppkey, x2", "q", "al_all", _BOUNDS)}) a JOIN ({_interval_sql("sweep", "l_suppkey, x2", "s2_i + q", "al_i",
        "round(exp(ln(pred) - half), 4) + 0.0 AS lower_forecast, round(exp(ln(pred) + half), 4) + 0.0 AS upper_forecast")}) b
        ON a.l_suppkey = b.l_suppkey AND a.x2 = b.x2""",
    ("sweep", "wfe", "ivp", "wf", "iva"),
)
def _(spark, sf):
    """The August means of every supplier as template, 640 values of x2."""
    template = pb(spark, sf).filter("month = 8").groupBy("l_suppkey").agg(F.avg("x1").alias("x1"))
    out = predict.scenario_sweep(template.withColumn("x2", F.lit(0.0)), within_fit(spark, sf), "x2", 1.0, 5.0, 640)
    out = rounded(out, "x2")
    return rounded(out, "prediction", "lower", "upper", "lower_forecast", "upper_forecast", digits=4)


SCALED = "(fe - (SELECT min(fe) FROM wfe)) * 4 / ((SELECT max(fe) FROM wfe) - (SELECT min(fe) FROM wfe))"


@query(
    "i16_rescale_effects",
    f"""SELECT l_suppkey, round(fe, 6) + 0.0 AS fe, round(scaled_fe, 6) + 0.0 AS scaled_fe, CAST(CASE WHEN scaled_fe < 1 THEN 1 WHEN scaled_fe < 2 THEN 2
          WHEN scaled_fe < 3 THEN 3 WHEN scaled_fe < 4.1 THEN 4 END AS INTEGER) AS layer, round_even(fe, 3) + 0.0 AS round_fe, round_even(scaled_fe, 3) + 0.0 AS round_scaled_fe
        FROM (SELECT l_suppkey, fe, {SCALED} AS scaled_fe FROM wfe)""",
    ("wfe",),
)
def _(spark, sf):
    out = predict.rescale_effects(within_fit(spark, sf).fixef.select("l_suppkey", "fe"))
    zero = F.lit(0.0)
    out = out.withColumns({c: F.col(c) + zero for c in ("round_fe", "round_scaled_fe")})
    return rounded(out, "fe", "scaled_fe")


@query("i17_rank_effects", "SELECT l_suppkey, round(fe, 6) + 0.0 AS fe FROM wfe ORDER BY wfe.fe DESC, l_suppkey LIMIT 5", ("wfe",))
def _(spark, sf):
    return rounded(predict.rank_effects(within_fit(spark, sf).fixef, "l_suppkey"), "fe")


