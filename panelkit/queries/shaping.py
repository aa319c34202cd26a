"""Sources, projections, filters, scalar functions, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import columns as fc
from ..operators import joins, lags, ranking
from ..operators.slices import entity_position
from ..sources import panels as src
from .base import events, longs, pa, pa_cells, pa_days, query, r6, raw, rounded, table


# ---- sources -------------------------------------------------------------
@query("s2_panel_from_events", "SELECT user_id, d, y, round(x, 6) + 0.0 AS x FROM cells", ("cells",))
def _(spark, sf):
    return rounded(pa_cells(spark, sf), "x")


@query(
    "s4_enrich_with_overrides",
    """SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 7 <> 0 THEN n_name END,
         CASE WHEN s_suppkey % 14 = 0 THEN 'override ' || CAST(s_suppkey AS VARCHAR) END) AS place,
         s_suppkey % 7 = 0 AS missed
       FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
)
def _(spark, sf):
    sup, nat = table(spark, sf, "supplier"), table(spark, sf, "nation")
    keys = sup.select("s_suppkey", "s_nationkey")
    lookup = keys.filter("s_suppkey % 7 <> 0").join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
    lookup = lookup.select("s_suppkey", F.col("n_name").alias("place"))
    overrides = keys.filter("s_suppkey % 14 = 0").select(
        "s_suppkey", F.concat_ws(" ", F.lit("override"), F.col("s_suppkey").cast("string")).alias("place")
    )
    out, misses = src.enrich_with_overrides(keys.select("s_suppkey"), lookup, overrides, "s_suppkey", ["place"])
    return out.join(misses.withColumn("missed", F.lit(True)), "s_suppkey", "left").select(
        "s_suppkey", "place", F.coalesce("missed", F.lit(False)).alias("missed")
    )


# ---- projection and predicates -------------------------------------------
@query("p1_project", "SELECT user_id, event_type FROM events")
def _(spark, sf):
    return table(spark, sf, "events").drop("ts", "value", "props", "event_id")


@query("p2_derive", "SELECT event_id, value * 2 AS twice, value > 50 AS high FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", (F.col("value") * 2).alias("twice"), (F.col("value") > 50).alias("high"))


@query("p3_rename", "SELECT o_orderkey AS id, o_totalprice AS total FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return o.withColumnsRenamed({"o_orderkey": "id", "o_totalprice": "total"})


@query(
    "p4_filter",
    """SELECT event_id, user_id FROM events WHERE NOT (CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20')
       AND value < 42 AND event_type <> 'view'""",
)
def _(spark, sf):
    ev = table(spark, sf, "events")
    ev = ev.filter(~cal.in_dates(ev, "ts", "2024-01-10", "2024-01-20") & (F.col("value") < 42) & (F.col("event_type") != "view"))
    return ev.select("event_id", "user_id")


@query("p5_isin", "SELECT user_id, t, y FROM pa WHERE t IN (5, 20)", ("pa",))
def _(spark, sf):
    return pa(spark, sf).filter(F.col("t").isin(5, 20)).select("user_id", "t", "y")


@query("p6_conditional", "SELECT event_id, CASE WHEN value > 100 THEN 1 ELSE 0 END AS high FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.when(F.col("value") > 100, 1).otherwise(0).alias("high"))


@query(
    "p7_interval_label",
    "SELECT user_id, t, CASE WHEN t < 10 THEN 'before' WHEN t <= 20 THEN 'inside' ELSE 'after' END AS label FROM pa",
    ("pa",),
)
def _(spark, sf):
    return pa(spark, sf).select("user_id", "t", fc.interval_label(F.col("t"), 10, 20).alias("label"))


BAND_SQL = """CASE WHEN rain = 0 THEN 'non' WHEN rain > 0 AND rain <= 0.1 THEN 'light'
  WHEN rain > 0.1 AND rain <= 0.3 THEN 'moderate' WHEN rain > 0.3 THEN 'heavy' END"""


@query("p8_intensity_band", f"SELECT d, {BAND_SQL} AS band FROM days", ("days",))
def _(spark, sf):
    return pa_days(spark, sf).select("d", fc.intensity_band(F.col("rain")).alias("band"))


@query(
    "p9_cut_bins",
    """SELECT o_orderkey, CASE WHEN v < 1 THEN 1 WHEN v < 2 THEN 2 WHEN v < 3 THEN 3 WHEN v < 4.1 THEN 4 END AS bin
       FROM (SELECT o_orderkey, o_totalprice / 100000 AS v FROM orders)""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("v", F.col("o_totalprice") / 100000)
    return o.select("o_orderkey", fc.cut_bins(F.col("v"), [0.0, 1.0, 2.0, 3.0, 4.1]).alias("bin"))


@query("p10_positions", "SELECT user_id, t, d FROM pa WHERE y >= 5", ("pa",))
def _(spark, sf):
    return pa(spark, sf).filter("y >= 5").select("user_id", "t", "d")


@query(
    "p11_one_hot",
    """SELECT event_id, CAST(event_type = 'error' AS INTEGER) * 1.0::DOUBLE AS event_type_error,
         CAST(event_type = 'purchase' AS INTEGER) * 1.0::DOUBLE AS event_type_purchase,
         CAST(event_type = 'signup' AS INTEGER) * 1.0::DOUBLE AS event_type_signup,
         CAST(event_type = 'view' AS INTEGER) * 1.0::DOUBLE AS event_type_view FROM events""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type")
    out, names = fc.one_hot(ev, "event_type", ["click", "error", "purchase", "signup", "view"])
    return out.select("event_id", *names)


@query(
    "p12_quadratic_log",
    """SELECT event_id, round(value * value, 6) + 0.0 AS value_sq,
         round(CASE WHEN value > 1 THEN ln(value - 1) END, 6) + 0.0 AS ln_value FROM events""",
)
def _(spark, sf):
    ev = fc.add_quadratic(table(spark, sf, "events").select("event_id", "value"), "value")
    ev = ev.withColumn("ln_value", fc.guarded_log(F.col("value") - 1))
    return rounded(ev.drop("value"), "value_sq", "ln_value")


@query(
    "p13_xy_extract",
    "SELECT user_id, y, rain FROM raw WHERE rain < 0.05 AND y IS NOT NULL AND user_id IN (SELECT user_id FROM spaced)",
    ("raw", "spaced"),
)
def _(spark, sf):
    df = raw(spark, sf)
    return joins.xy_extract(df, "user_id", ["y", "rain"], ranking.sample_entities(df, "user_id", 9), F.col("rain") < 0.05)


# ---- joins ----------------------------------------------------------------
@query("j1_attach_axis", "SELECT c.user_id, c.d, CAST(t AS BIGINT) AS t FROM cells c LEFT JOIN days USING (d)", ("cells", "days"))
def _(spark, sf):
    cells = pa_cells(spark, sf)
    axis = src.time_axis(events(spark, sf), "d")
    return longs(src.attach_axis(cells, axis, "d").select("user_id", "d", "t"), "t")


@query(
    "j4_gap_lag_by_join",
    "SELECT a.user_id, a.t, b.y AS lag7 FROM pa a LEFT JOIN pa b ON a.user_id = b.user_id AND b.t = a.t - 7",
    ("pa",),
)
def _(spark, sf):
    df = pa(spark, sf).select("user_id", "t", "y")
    return lags.gap_aware_lag_by_join(df, "user_id", "t", "y", 7, "lag7").select("user_id", "t", "lag7")


@query(
    "j5_anti_join",
    "SELECT DISTINCT user_id FROM cells WHERE user_id NOT IN (SELECT user_id FROM cells WHERE d = DATE '2024-01-13')",
    ("cells",),
)
def _(spark, sf):
    # only the needed day is scanned on the right side
    ev = table(spark, sf, "events")
    seen = ev.filter(cal.in_dates(ev, "ts", "2024-01-13", "2024-01-13")).select("user_id")
    return joins.rows_not_in(ev.select("user_id").distinct(), seen, ["user_id"])


@query(
    "j6_semi_join",
    "SELECT user_id, t, y FROM pa WHERE user_id IN (SELECT user_id FROM spaced)",
    ("pa", "spaced"),
)
def _(spark, sf):
    df = pa(spark, sf)
    return joins.rows_of_entities(df, ranking.sample_entities(df, "user_id", 9), "user_id").select("user_id", "t", "y")


@query(
    "j7_donor_rows",
    """SELECT u.user_id, d.t, d.rain, d.wind FROM (SELECT DISTINCT user_id FROM cells) u, days d
       WHERE NOT EXISTS (SELECT 1 FROM pa p WHERE p.user_id = u.user_id AND p.t = d.t)""",
    ("cells", "days", "pa"),
)
def _(spark, sf):
    days = pa_days(spark, sf)
    out = joins.donor_rows(
        pa(spark, sf), "user_id", "t", days.agg(F.max("t")).scalar(), F.broadcast(days), ["rain", "wind"]
    )
    return out.select("user_id", "t", "rain", "wind")


@query(
    "j8_scenario_grid",
    """SELECT s_suppkey, s_nationkey, round(10.0::DOUBLE + i * (80.0::DOUBLE / 639.0), 6) + 0.0 AS temp
       FROM supplier, (SELECT unnest(generate_series(0, 639)) AS i)""",
)
def _(spark, sf):
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return rounded(joins.scenario_grid(sup, "temp", 10, 90, 640), "temp")


# ---- scalar functions -------------------------------------------------------
@query("f1_parse_date", "SELECT event_id, CAST(ts AS DATE) AS d FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.to_date(F.date_format("ts", "yyyy-MM-dd"), "yyyy-MM-dd").alias("d"))


@query("f2_month_day", "SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(day(o_orderdate) AS BIGINT) AS day FROM orders")
def _(spark, sf):
    o = cal.add_calendar(table(spark, sf, "orders"), "o_orderdate")
    return longs(o.select("o_orderkey", "month", "day"), "month", "day")


WEEKDAY_SQL = "['Montag','Dienstag','Mittwoch','Donnerstag','Freitag','Samstag','Sonntag'][isodow({0})]"


@query("f3_weekday", f"SELECT o_orderkey, {WEEKDAY_SQL.format('o_orderdate')} AS weekday FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", cal.weekday_name(F.col("o_orderdate")).alias("weekday"))


@query(
    "f4_abbreviate_reorder",
    f"SELECT o_orderkey, substr({WEEKDAY_SQL.format('o_orderdate')}, 1, 2) AS short, isodow(o_orderdate) AS pos FROM orders",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("short", cal.weekday_short(cal.weekday_name(F.col("o_orderdate"))))
    return o.select("o_orderkey", "short", cal.weekday_order(F.col("short")).cast("long").alias("pos"))


def _flag_sql(cond: str, name: str) -> str:
    return f"CAST(CAST({cond} AS INTEGER) AS DOUBLE) AS \"{name}\""


@query(
    "f5_flags",
    "SELECT user_id, d, "
    + ", ".join(
        _flag_sql(c, n)
        for c, n in [
            ("month(d) = 1", "JanuarySlope"), ("month(d) = 2", "FebruarySlope"), ("month(d) = 3", "MarchSlope"),
            ("month(d) = 11", "NovemberSlope"), ("isodow(d) >= 6", "IsWeekend"),
            ("d BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'", "IsSummerHoliday"), ("temp <= 49.5", "IsFreezing"),
        ]
    )
    + " FROM raw",
    ("raw",),
)
def _(spark, sf):
    df = cal.add_calendar(raw(spark, sf), "d")
    df = cal.add_flags(df, "d", temperature="temp", holiday=("2024-01-08", "2024-01-14"), freezing=49.5)
    return df.select(
        "user_id", "d", "JanuarySlope", "FebruarySlope", "MarchSlope", "NovemberSlope",
        "IsWeekend", "IsSummerHoliday", "IsFreezing",
    )


@query(
    "f6_math",
    """SELECT event_id, round(ln(value), 6) + 0.0 AS l, round(exp(value / 100), 6) + 0.0 AS e,
       round(sqrt(value), 6) + 0.0 AS s, round(abs(value - 50), 6) + 0.0 AS a FROM events""",
)
def _(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", r6(fc.guarded_log(v)).alias("l"), r6(F.exp(v / 100)).alias("e"),
        r6(F.sqrt(v)).alias("s"), r6(F.abs(v - 50)).alias("a"),
    )


@query("f7_round_half_even", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) AS q FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 8, 2).alias("q"))


@query("f8_concat_trim", "SELECT event_id, 'User ' || CAST(user_id AS VARCHAR) || ' (' || event_type || ')' AS label FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events")
    label = F.concat_ws(" ", F.lit("User"), F.col("user_id").cast("string"), F.concat(F.lit("("), "event_type", F.lit(")")))
    return ev.select("event_id", F.trim(F.concat(F.lit("  "), label, F.lit(" "))).alias("label"))


@query("f9_entity_of_row_key", "SELECT user_id, d, 'user-' || CAST(user_id AS VARCHAR) AS entity FROM cells", ("cells",))
def _(spark, sf):
    c = pa_cells(spark, sf)
    key = F.concat_ws("-", F.lit("user"), F.col("user_id").cast("string"), F.col("d").cast("string"))
    return c.select("user_id", "d", fc.entity_of_row_key(key).alias("entity"))


@query("f10_strip_prefix", "SELECT c_custkey, regexp_replace(c_name, '^Customer#0*', '') AS short FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fc.strip_prefix(F.col("c_name"), "^Customer#0*").alias("short"))


@query(
    "f11_sequence",
    """SELECT s_suppkey, i, round(s_acctbal + i * (2 * s_acctbal - s_acctbal) / 8, 6) + 0.0 AS v
       FROM supplier, (SELECT unnest(generate_series(0, 8)) AS i)""",
)
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    out = fc.linspace(s, F.col("s_acctbal"), 2 * F.col("s_acctbal"), 9, "v")
    i = F.round((F.col("v") - F.col("s_acctbal")) / F.col("s_acctbal") * 8).cast("long")
    return rounded(out.select("s_suppkey", i.alias("i"), "v"), "v")


@query(
    "f12_min_max_rescale",
    """SELECT c_custkey, round((c_acctbal - lo) * 4 / (hi - lo), 6) + 0.0 AS scaled
       FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    lo, hi = c.agg(F.min("c_acctbal")).scalar(), c.agg(F.max("c_acctbal")).scalar()
    return c.select("c_custkey", r6((F.col("c_acctbal") - lo) * 4 / (hi - lo)).alias("scaled"))


@query(
    "f14_null_functions",
    "SELECT user_id, d, coalesce(y, -9) AS y_filled, y IS NULL AS y_missing, CAST(NULL AS INTEGER) AS empty FROM raw",
    ("raw",),
)
def _(spark, sf):
    y = F.col("y")
    return raw(spark, sf).select(
        "user_id", "d", F.coalesce(y, F.lit(-9)).alias("y_filled"), y.isNull().alias("y_missing"),
        F.lit(None).cast("int").alias("empty"),
    )


# ---- sort, limit, sets --------------------------------------------------------
@query("o1_sort", "SELECT user_id, t, y FROM raw ORDER BY y DESC NULLS LAST, user_id, t", ("raw",))
def _(spark, sf):
    df = raw(spark, sf).select("user_id", "t", "y")
    return df.orderBy(F.col("y").desc_nulls_last(), "user_id", "t")


@query(
    "o3_positional_slice",
    """SELECT user_id, CAST(pos AS BIGINT) AS pos, d FROM (SELECT user_id, d,
         row_number() OVER (PARTITION BY user_id ORDER BY t) AS pos FROM pa) WHERE pos BETWEEN 3 AND 5""",
    ("pa",),
)
def _(spark, sf):
    df = entity_position(pa(spark, sf).select("user_id", "t", "d"), "user_id", "t")
    return longs(df.filter(F.col("pos").between(3, 5)).select("user_id", "pos", "d"), "pos")


@query(
    "o4_union",
    """SELECT user_id, d, 'low' AS part FROM cells WHERE y < 3 UNION ALL
       SELECT user_id, d, 'high' FROM cells WHERE y >= 3""",
    ("cells",),
)
def _(spark, sf):
    c = pa_cells(spark, sf).select("user_id", "d", "y")
    low = c.filter("y < 3").withColumn("part", F.lit("low"))
    high = c.filter("y >= 3").withColumn("part", F.lit("high"))
    return low.unionByName(high).drop("y")


@query("o5_set_difference", "SELECT t FROM days EXCEPT SELECT t FROM days WHERE t BETWEEN 15 AND 28", ("days",))
def _(spark, sf):
    t = pa_days(spark, sf).select("t")
    return t.exceptAll(t.filter(F.col("t").between(15, 28)))


@query("o6_distinct", "SELECT DISTINCT event_type, user_id FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_type", "user_id").distinct()


@query("o7_pull_dates", "SELECT d FROM pa WHERE user_id = 7 AND y > 3", ("pa",))
def _(spark, sf):
    return pa(spark, sf).filter("user_id = 7 AND y > 3").select("d")


