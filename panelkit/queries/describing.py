"""Quality checks, grouped statistics, windows, ranking and smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import describe, lags, quality, ranking, smooth
from ..sources.panels import time_axis
from .base import cte, events, longs, pa, pa_cells, pa_days, query, raw, rounded, table
from .shaping import BAND_SQL

PROFILE_SQL = """SELECT '{c}' AS column_name, round(min({c}), 6) + 0.0 AS min, round(quantile_cont({c}, 0.25), 6) + 0.0 AS q1,
  round(quantile_cont({c}, 0.5), 6) + 0.0 AS median, round(avg({c}), 6) + 0.0 AS mean, round(quantile_cont({c}, 0.75), 6) + 0.0 AS q3,
  round(max({c}), 6) + 0.0 AS max, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null
  FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM raw)"""


# ---- data quality ------------------------------------------------------------
@query("q1_profile", " UNION ALL ".join(PROFILE_SQL.format(c=c) for c in ("y", "wind", "temp", "rain")), ("raw",))
def _(spark, sf):
    out = quality.profile(raw(spark, sf), ["y", "wind", "temp", "rain"])
    return rounded(out, "min", "q1", "median", "mean", "q3", "max")


@query(
    "q2_panel_balance",
    """SELECT n_rows, count(*) AS n_entities, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share
       FROM (SELECT user_id, count(*) AS n_rows FROM cells GROUP BY 1) GROUP BY 1""",
    ("cells",),
)
def _(spark, sf):
    return rounded(quality.panel_balance(pa_cells(spark, sf), "user_id"), "share")


@query(
    "q3_incomplete_entities",
    "SELECT user_id, count(*) AS n_rows FROM cells GROUP BY 1 HAVING count(*) < (SELECT max(t) FROM days)",
    ("cells", "days"),
)
def _(spark, sf):
    n_times = events(spark, sf).agg(F.count_distinct("d")).scalar()
    return quality.incomplete_entities(pa_cells(spark, sf), "user_id", n_times)


CONSISTENCY_SQL = """SELECT '{c}' AS column_name, d, count(DISTINCT {c}) {plus} AS n_values
  FROM raw GROUP BY d HAVING count(DISTINCT {c}) {plus} > 1"""


def _consistency_sql(plus: str) -> str:
    return " UNION ALL ".join(CONSISTENCY_SQL.format(c=c, plus=plus.format(c=c)) for c in ("wind", "temp", "rain", "snow"))


@query("q4_consistency_check", _consistency_sql("+ max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"), ("raw",))
def _(spark, sf):
    return quality.consistency_check(raw(spark, sf), "d", ["wind", "temp", "rain", "snow"])


@query("q4_consistency_check_null_free", _consistency_sql(""), ("raw",))
def _(spark, sf):
    return quality.consistency_check(raw(spark, sf), "d", ["wind", "temp", "rain", "snow"], count_null=False)


@query(
    "q5_missing_times",
    """SELECT u.user_id, d.t FROM (SELECT DISTINCT user_id FROM cells) u, days d
       WHERE NOT EXISTS (SELECT 1 FROM pa p WHERE p.user_id = u.user_id AND p.t = d.t)""",
    ("cells", "days", "pa"),
)
def _(spark, sf):
    n_times = events(spark, sf).agg(F.count_distinct("d")).scalar()
    return quality.missing_times(pa(spark, sf).select("user_id", "t"), "user_id", "t", n_times)


@query(
    "q6_gap_runs",
    """SELECT user_id, prev + 1 AS gap_start, t - 1 AS gap_end, t - prev - 1 AS gap_len FROM (
         SELECT user_id, t, lag(t, 1, 0) OVER (PARTITION BY user_id ORDER BY t) AS prev FROM (
           SELECT user_id, t FROM pa UNION ALL SELECT DISTINCT user_id, (SELECT max(t) + 1 FROM days) FROM pa)) WHERE t - prev > 1""",
    ("pa", "days"),
)
def _(spark, sf):
    return quality.gap_runs(pa(spark, sf), "user_id", "t", pa_days(spark, sf).count())


@query("q6_first_observed", "SELECT user_id, min(d) AS first_d FROM cells GROUP BY 1", ("cells",))
def _(spark, sf):
    return quality.first_observed(events(spark, sf), "user_id", "d")


@query("q7_sentinel_to_null", "SELECT user_id, d, nullif(wind, -1.0::DOUBLE) AS wind FROM raw", ("raw",))
def _(spark, sf):
    return quality.sentinel_to_null(raw(spark, sf), "wind").select("user_id", "d", "wind")


REPAIR_SQL = """SELECT user_id, d, coalesce(nullif(wind, -1), max(nullif(wind, -1)) OVER (PARTITION BY d)) AS wind,
  coalesce(temp, max(temp) OVER (PARTITION BY d)) AS temp FROM raw"""


def _repaired(spark, sf):
    df = quality.sentinel_to_null(raw(spark, sf), "wind")
    return quality.fill_from_group(df, ["wind", "temp"], "d")


@query("q8_fill_from_group", f"SELECT user_id, d, wind, round(temp, 4) + 0.0 AS temp FROM ({REPAIR_SQL})", ("raw",))
def _(spark, sf):
    return rounded(_repaired(spark, sf).select("user_id", "d", "wind", "temp"), "temp", digits=4)


@query("q9_drop_nulls", "SELECT user_id, d FROM raw WHERE y IS NOT NULL AND temp IS NOT NULL", ("raw",))
def _(spark, sf):
    return quality.drop_nulls(raw(spark, sf), ["y", "temp"]).select("user_id", "d")


@query("q10_null_indicator", "SELECT user_id, d, y IS NULL AS missing_indicator FROM raw", ("raw",))
def _(spark, sf):
    return quality.null_indicator(raw(spark, sf), "y").select("user_id", "d", "missing_indicator")


@query("q11_null_count_per_entity", "SELECT user_id, count(*) - count(y) AS n_null FROM raw GROUP BY 1", ("raw",))
def _(spark, sf):
    return quality.null_count_per_entity(raw(spark, sf), "user_id", "y")


@query("q12_distinct_after_repair", f"SELECT DISTINCT wind FROM ({REPAIR_SQL}) WHERE d = DATE '2024-01-05'", ("raw",))
def _(spark, sf):
    day = F.col("d") == F.lit("2024-01-05").cast("date")
    return quality.distinct_values(_repaired(spark, sf), "wind", day)


# ---- aggregation --------------------------------------------------------------
@query(
    "a1_mean_median",
    "SELECT user_id, round(avg(y), 6) + 0.0 AS mean_y, round(median(CAST(y AS DOUBLE)), 6) + 0.0 AS median_y FROM raw GROUP BY 1",
    ("raw",),
)
def _(spark, sf):
    return rounded(describe.mean_median(raw(spark, sf), "user_id", "y"), "mean_y", "median_y")


COMPARE_SQL = """SELECT {l} AS label, round(avg(y), 6) + 0.0 AS mean_y, round(var_samp(y), 6) + 0.0 AS var_y
  FROM raw WHERE {w} GROUP BY 1"""


@query(
    "a2_compare_groups",
    COMPARE_SQL.format(l="CASE WHEN t < 10 THEN 'before' WHEN t <= 20 THEN 'inside' ELSE 'after' END", w="y IS NOT NULL"),
    ("raw",),
)
def _(spark, sf):
    df = raw(spark, sf)
    return rounded(describe.compare_groups(df, fc.interval_label(F.col("t"), 10, 20), "y"), "mean_y", "var_y")


@query(
    "a2_compare_two_points",
    COMPARE_SQL.format(l="CASE WHEN t IN (10, 20) THEN 'inside' ELSE 'outside' END", w="y IS NOT NULL AND temp IS NOT NULL"),
    ("raw",),
)
def _(spark, sf):
    label = F.when(F.col("t").isin(10, 20), "inside").otherwise("outside")
    return rounded(describe.compare_groups(raw(spark, sf), label, "y", ["y", "temp"]), "mean_y", "var_y")


@query(
    "a3_above_mean",
    COMPARE_SQL.format(l="CASE WHEN rain > (SELECT avg(rain) FROM raw) THEN 'above' ELSE 'below' END", w="y IS NOT NULL"),
    ("raw",),
)
def _(spark, sf):
    df = raw(spark, sf)
    return rounded(describe.compare_groups(df, describe.above_mean_label(df, "rain"), "y"), "mean_y", "var_y")


@query(
    "a4_event_days",
    """SELECT CAST(t AS BIGINT) AS t, round(avg(y), 6) + 0.0 AS mean_y, round(max(snow), 6) + 0.0 AS snow, round(max(rain), 6) + 0.0 AS rain
       FROM raw WHERE snow > 0 AND y IS NOT NULL GROUP BY t ORDER BY snow DESC""",
    ("raw",),
)
def _(spark, sf):
    out = describe.event_day_table(raw(spark, sf), "t", "y", F.col("snow") > 0, ["snow", "rain"])
    return longs(rounded(out, "mean_y", "snow", "rain"), "t").orderBy(F.col("snow").desc_nulls_last())


@query(
    "a5_filtered_mean",
    "SELECT round(avg(y), 6) + 0.0 AS mean_y FROM raw WHERE snow = 0 AND rain = 0 AND y IS NOT NULL AND temp IS NOT NULL",
    ("raw",),
)
def _(spark, sf):
    where = (F.col("snow") == 0) & (F.col("rain") == 0)
    return rounded(describe.filtered_mean(raw(spark, sf), "y", where, ["y", "temp"]), "mean_y")


@query(
    "a6_category_share",
    f"SELECT {BAND_SQL} AS category, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS pct FROM pa GROUP BY 1",
    ("pa",),
)
def _(spark, sf):
    return rounded(describe.category_share(pa(spark, sf), fc.intensity_band(F.col("rain"))), "pct")


@query(
    "a7_mean_by_band",
    f"SELECT {BAND_SQL} AS band, round(avg(y), 6) + 0.0 AS mean_y FROM raw WHERE y IS NOT NULL GROUP BY 1",
    ("raw",),
)
def _(spark, sf):
    df = raw(spark, sf).na.drop("any", subset=["y"])
    return rounded(describe.mean_by(df, [fc.intensity_band(F.col("rain")).alias("band")], "y"), "mean_y")


COR_SQL = """round((avg(x * y) - avg(x) * avg(y)) / nullif(sqrt((avg(x * x) - avg(x) * avg(x)) * (avg(y * y) - avg(y) * avg(y))), 0), 4) + 0.0"""


@query(
    "a8_correlation",
    f"SELECT {COR_SQL} AS cor, count(*) AS n FROM raw WHERE y IS NOT NULL",
    ("raw",),
)
def _(spark, sf):
    return rounded(describe.correlation(raw(spark, sf), "x", "y"), "cor", digits=4)


@query(
    "a9_correlation_by_entity",
    f"""SELECT user_id, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN {COR_SQL} END AS cor, count(*) AS n
        FROM raw WHERE y IS NOT NULL AND rain > 0 GROUP BY 1""",
    ("raw",),
)
def _(spark, sf):
    df = raw(spark, sf).filter((F.col("rain") > 0) & F.col("y").isNotNull())
    return rounded(describe.correlation(df, "x", "y", ["user_id"]), "cor", digits=4)


HIST_SQL = """SELECT CAST(b AS INTEGER) AS bin, CASE WHEN b > 0 THEN {lo} + (b - 1) * {w} END AS "left",
  CASE WHEN b <= {k} THEN {lo} + b * {w} END AS "right", coalesce(n, 0) AS n
  FROM (SELECT unnest(generate_series(0, {k} + 1)) AS b) LEFT JOIN (SELECT CASE WHEN v < {lo} THEN 0 WHEN v > {lo} + {k} * {w} THEN {k} + 1
  ELSE greatest(1, least({k}, ceil((v - {lo}) / {w}))) END AS b, count(*) AS n FROM ({src}) WHERE v IS NOT NULL GROUP BY 1) USING (b)"""


@query("a10_histogram", HIST_SQL.format(lo="0.0::DOUBLE", w="15.0::DOUBLE", k=24, src="SELECT value AS v FROM events"))
def _(spark, sf):
    return describe.histogram(table(spark, sf, "events"), "value", 0.0, 360.0, 15.0)


@query(
    "a10_histogram_auto",
    """SELECT CAST(b AS INTEGER) AS bin, lo + (b - 1) * w AS "left", lo + b * w AS "right", count(v) AS n FROM (
         SELECT lo, w, unnest(generate_series(1, CAST(round((hi - lo) / w) AS BIGINT))) AS b FROM (
           SELECT floor(a / w) * w AS lo, ceil(z / w) * w AS hi, w FROM (
             SELECT a, z, base * CASE WHEN raw > 7 * base THEN 10 WHEN raw > 2.8 * base THEN 5 WHEN raw > 1.4 * base THEN 2 ELSE 1 END AS w FROM (
               SELECT a, z, raw, 10.0::DOUBLE ** floor(log10(raw)) AS base FROM (
                 SELECT min(o_totalprice) AS a, max(o_totalprice) AS z, (max(o_totalprice) - min(o_totalprice)) / ceil(log2(count(*)) + 1) AS raw
                 FROM orders)))))
       LEFT JOIN (SELECT o_totalprice AS v FROM orders) ON v > lo + (b - 1) * w AND v <= lo + b * w GROUP BY ALL""",
)
def _(spark, sf):
    return describe.histogram_auto(table(spark, sf, "orders"), "o_totalprice")


@query(
    "a12_count_distinct",
    "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS n_types FROM events GROUP BY 1",
)
def _(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("n_types"))


@query("a13_constant_of_group", "SELECT d, max(wind) AS wind FROM pa GROUP BY 1", ("pa",))
def _(spark, sf):
    return pa(spark, sf).groupBy("d").agg(F.max("wind").alias("wind"))


# ---- windows and ranking ---------------------------------------------------------
@query("w1_time_ordinal", "SELECT d, CAST(t AS BIGINT) AS t FROM days", ("days",))
def _(spark, sf):
    return longs(time_axis(events(spark, sf), "d"), "t")


@query(
    "w2_observed_lags",
    """SELECT user_id, t, lag(y, 1) OVER (PARTITION BY user_id ORDER BY d) AS lag1,
       lag(y, 7) OVER (PARTITION BY user_id ORDER BY d) AS lag7 FROM pa""",
    ("pa",),
)
def _(spark, sf):
    df = pa(spark, sf).select("user_id", "t", "y")
    return lags.observed_lags(df, "user_id", "t", "y", {"lag1": 1, "lag7": 7}).drop("y")


@query(
    "w3_gap_lag",
    """SELECT a.user_id, a.t, b.y AS lag1, c.y AS lag7 FROM raw a LEFT JOIN raw b ON a.user_id = b.user_id AND b.t = a.t - 1
       LEFT JOIN raw c ON a.user_id = c.user_id AND c.t = a.t - 7""",
    ("raw",),
)
def _(spark, sf):
    df = raw(spark, sf).select("user_id", "t", "y")
    return lags.gap_aware_lags(df, "user_id", "t", "y", {"lag1": 1, "lag7": 7}).drop("y")


def _ma_sql(w: int) -> str:
    frame = f"OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN {(w - 1) // 2} PRECEDING AND {w // 2} FOLLOWING)"
    return f"round(CASE WHEN count(y) {frame} = {w} THEN avg(y) {frame} END, 6) + 0.0 AS ma{w}"


@query("w4_moving_average", f"SELECT user_id, t, {_ma_sql(7)}, {_ma_sql(20)} FROM raw", ("raw",))
def _(spark, sf):
    df = raw(spark, sf).select("user_id", "t", "y")
    out = smooth.moving_average(df, "user_id", "t", "y", {"ma7": 7, "ma20": 20})
    return rounded(out.drop("y"), "ma7", "ma20")


def lowess_ctes(p: str, src: str, entity: str, y: str) -> None:
    """``<p>f3`` holds the trend. Every row is an anchor, as long as no entity has more than 200 rows."""
    cte(
        f"{p}0",
        f"""SELECT {entity}, t, CAST({y} AS DOUBLE) AS y, row_number() OVER (PARTITION BY {entity} ORDER BY t) AS i,
           count(*) OVER (PARTITION BY {entity}) AS n, 1.0::DOUBLE AS rw FROM {src}""",
        (src,),
    )
    for it in range(4):
        cte(
            f"{p}f{it}",
            f"""SELECT *, CASE WHEN sqrt(greatest(sdd / sw - (sd / sw) ** 2, 0)) <= 0.001 * (n - 1) THEN sy / sw
                ELSE sy / sw - (sdy - sd * sy / sw) / (sw * (sdd / sw - (sd / sw) ** 2)) * sd / sw END AS fit FROM (
              SELECT {entity}, t, i, n, y, rw, sum(w) AS sw, sum(w * u) AS sd, sum(w * u * u) AS sdd, sum(w * yj) AS sy, sum(w * u * yj) AS sdy FROM (
                SELECT {entity}, t, i, n, y, rw, yj, CAST(j - i AS DOUBLE) AS u, rwj * CASE WHEN abs(j - i) <= 0.001 * h THEN 1
                  WHEN abs(j - i) <= 0.999 * h THEN (1 - (abs(j - i) / h) ** 3) ** 3 ELSE 0 END AS w FROM (
                  SELECT a.{entity}, a.t, a.i, a.n, a.y, a.rw, b.i AS j, b.y AS yj, b.rw AS rwj,
                    CAST(greatest(a.i - a.lo, a.lo + a.k - 1 - a.i) AS DOUBLE) AS h
                  FROM (SELECT *, greatest(1, least(n - k + 1, i - k // 2)) AS lo FROM
                    (SELECT *, greatest(2, least(n, CAST(floor(n * (2.0::DOUBLE / 3) + 1e-7) AS BIGINT))) AS k FROM {p}{it})) a
                  JOIN {p}{it} b USING ({entity}))) WHERE w > 0 GROUP BY {entity}, t, i, n, y, rw)""",
            (f"{p}{it}",),
        )
        cte(
            f"{p}{it + 1}",
            f"""SELECT {entity}, t, y, i, n, CASE WHEN c < 1e-7 * mr THEN rw WHEN r <= 0.001 * c THEN 1 WHEN r <= 0.999 * c
                  THEN (1 - (r / c) ** 2) ** 2 ELSE 0 END AS rw FROM (
                SELECT *, abs(y - fit) AS r, 6 * median(abs(y - fit)) OVER (PARTITION BY {entity}) AS c,
                  avg(abs(y - fit)) OVER (PARTITION BY {entity}) AS mr FROM {p}f{it})""",
            (f"{p}f{it}",),
        )


lowess_ctes("lw", "pa", "user_id", "y")


@query("w5_lowess", "SELECT user_id, t, round(fit, 4) + 0.0 AS trend FROM lwf3", ("lwf3",))
def _(spark, sf):
    out = smooth.lowess(pa(spark, sf), "user_id", "t", "y")
    return rounded(out.select("user_id", "t", "trend"), "trend", digits=4)


KS_SQL = """SELECT g.user_id, g.point, round(g.x0, 6) + 0.0 AS x0, round(sum(CASE WHEN abs(r.t - g.x0) <= 4 * sd THEN
    exp(-0.5 * ((r.t - g.x0) / sd) ** 2) * y END) / sum(CASE WHEN abs(r.t - g.x0) <= 4 * sd THEN exp(-0.5 * ((r.t - g.x0) / sd) ** 2) END), 6) + 0.0 AS y_hat
  FROM (SELECT user_id, i AS point, a + i * ((b - a) / (m - 1)) AS x0, 0.25 / 0.6744897501960817 * 3.0 AS sd FROM
    (SELECT user_id, CAST(min(t) AS DOUBLE) AS a, max(t) AS b, greatest(100, count(*)) AS m FROM raw WHERE y IS NOT NULL GROUP BY 1),
    (SELECT unnest(generate_series(0, 99)) AS i)) g JOIN raw r ON r.user_id = g.user_id AND r.y IS NOT NULL GROUP BY 1, 2, g.x0"""


@query("w6_kernel_smooth", KS_SQL, ("raw",))
def _(spark, sf):
    out = smooth.kernel_smooth(raw(spark, sf), "t", "y", 3.0, ["user_id"])
    return rounded(out, "x0", "y_hat")


cte(
    "ranked",
    """SELECT user_id, m, row_number() OVER (ORDER BY m NULLS LAST, user_id) AS r, count(*) OVER () AS n
       FROM (SELECT user_id, avg(y) AS m FROM raw GROUP BY 1)""",
    ("raw",),
)
NINE_SQL = "(r <= 3 OR r BETWEEN n // 2 - 1 AND n // 2 + 1 OR r > n - 3)"


@query("w7_rank_slice", f"SELECT user_id, r AS rank, round(m, 6) + 0.0 AS mean_y FROM ranked WHERE {NINE_SQL}", ("ranked",))
def _(spark, sf):
    picked = ranking.pick_bottom_middle_top(ranking.rank_entities(raw(spark, sf), "user_id", "y"))
    return longs(rounded(picked.select("user_id", "rank", "mean_y"), "mean_y"), "rank")


@query(
    "w7_rank_evenly_spaced",
    """SELECT user_id, r AS rank FROM ranked WHERE r IN (SELECT round_even(1.0::DOUBLE + i * (n - 1) / 3.0::DOUBLE, 0)
       FROM (SELECT unnest(generate_series(0, 3)) AS i), (SELECT max(n) AS n FROM ranked))""",
    ("ranked",),
)
def _(spark, sf):
    picked = ranking.pick_evenly_spaced(ranking.rank_entities(raw(spark, sf), "user_id", "y"), 4)
    return longs(picked.select("user_id", "rank"), "rank")


@query("w8_entity_sample", "SELECT user_id FROM spaced", ("spaced",))
def _(spark, sf):
    return ranking.sample_entities(pa_cells(spark, sf), "user_id", 9).select("user_id")


