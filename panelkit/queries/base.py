"""The two panels behind the registered queries, in Spark and in SQL.

PA: events per user and day. PB: order lines per supplier and month. The input
has no nulls, so the quality queries inject nulls and -1 readings by a modulo
rule written the same way in both languages.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import guarded_log
from ..sources.panels import attach_axis, panel_from_events, time_axis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = (needs, sql)


def sql_with(needs: tuple[str, ...], body: str) -> str:
    """The body behind the named common table expressions and all they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body
    word = "WITH RECURSIVE " if any(re.search(rf"\bFROM {n}\b", CTES[n][1]) for n in order) else "WITH "
    return word + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


def query(key: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql_with(needs, sql)
        return fn

    return register


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in cols})


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("d", F.to_date("ts"))


def pa_days(spark: SparkSession, sf: str) -> DataFrame:
    """One row per day: ordinal t and the day-level readings."""
    ev = events(spark, sf)
    of = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    days = time_axis(
        ev, "d", "t",
        {"day_n": F.count(F.lit(1)), "day_x": F.avg("value"), "n_err": of("error"), "n_sig": of("signup")},
    )
    n, e, s = (F.col(c).cast("double") for c in ("day_n", "n_err", "n_sig"))
    return days.select(
        "d", "t", "day_x",
        (n / 10.0).alias("wind"),
        F.round("day_x", 4).alias("temp"),
        F.when(5 * e > n, (5 * e - n) / n).otherwise(0.0).alias("rain"),
        F.when(100 * s > 21 * n, (100 * s - 21 * n) / n).otherwise(0.0).alias("snow"),
    )


def pa_cells(spark: SparkSession, sf: str) -> DataFrame:
    return panel_from_events(events(spark, sf), "user_id", F.col("d"), "d", x=F.avg("value"))


def pa(spark: SparkSession, sf: str) -> DataFrame:
    return attach_axis(pa_cells(spark, sf), pa_days(spark, sf), "d")


cte("day0", """SELECT CAST(ts AS DATE) AS d, CAST(count(*) AS DOUBLE) AS n, avg(value) AS day_x,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) AS e,
  CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS DOUBLE) AS s FROM events GROUP BY 1""")
cte("days", """SELECT d, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS t, day_x,
  n / 10.0 AS wind, round(day_x, 4) AS temp,
  CASE WHEN 5 * e > n THEN (5 * e - n) / n ELSE CAST(0 AS DOUBLE) END AS rain,
  CASE WHEN 100 * s > 21 * n THEN (100 * s - 21 * n) / n ELSE CAST(0 AS DOUBLE) END AS snow FROM day0""", ("day0",))
cte("cells", """SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS y, avg(value) AS x FROM events GROUP BY 1, 2""")
cte("pa", """SELECT d, user_id, y, x, t, day_x, wind, temp, rain, snow FROM cells JOIN days USING (d)""", ("cells", "days"))


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """PA with injected nulls and -1 wind readings."""
    day, u = F.dayofmonth("d"), F.col("user_id")
    return pa(spark, sf).withColumns(
        {
            "y": F.when((u * 31 + day) % 97 != 0, F.col("y")),
            "wind": F.when((u * 31 + day) % 89 == 0, F.lit(-1.0)).otherwise(F.col("wind")),
            "temp": F.when((u * 17 + day) % 101 != 0, F.col("temp")),
        }
    )


cte("raw", """SELECT d, user_id, CASE WHEN (user_id * 31 + day(d)) % 97 <> 0 THEN y END AS y, x, t, day_x,
  CASE WHEN (user_id * 31 + day(d)) % 89 = 0 THEN -1.0 ELSE wind END AS wind,
  CASE WHEN (user_id * 17 + day(d)) % 101 <> 0 THEN temp END AS temp, rain, snow FROM pa""", ("pa",))


def pb(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per supplier and month, with covariates, ln y and the month number."""
    li = table(spark, sf, "lineitem").withColumn("m", F.trunc(F.col("l_shipdate").cast("date"), "month"))
    cells = panel_from_events(
        li, "l_suppkey", F.col("m"), "m", x1=F.avg(F.col("l_discount") * 10), x2=F.avg(F.col("l_quantity") / 10)
    )
    out = attach_axis(cells, time_axis(li, "m"), "m")
    return out.withColumns({"month": F.month("m"), "ly": guarded_log(F.col("y"))})


cte("pb0", """SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS m, count(*) AS y,
  avg(l_discount * 10) AS x1, avg(l_quantity / 10) AS x2 FROM lineitem GROUP BY 1, 2""")
cte("pb", """SELECT m, l_suppkey, y, x1, x2, t, month(m) AS month, ln(CAST(y AS DOUBLE)) AS ly FROM pb0 JOIN
  (SELECT m, CAST(row_number() OVER (ORDER BY m) AS INTEGER) AS t FROM (SELECT DISTINCT m FROM pb0)) a USING (m)""", ("pb0",))
cte("spaced", """SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT user_id FROM cells)) WHERE r IN (SELECT round_even(1.0::DOUBLE + i * (n - 1) / 8.0::DOUBLE, 0)
  FROM (SELECT unnest(generate_series(0, 8)) AS i))""", ("cells",))
