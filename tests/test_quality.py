import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelkit.functions import calendar as cal
from panelkit.functions import columns as fc
from panelkit.operators import describe, joins, lags, quality, ranking, slices


@pytest.fixture(scope="module")
def gap3(spark):
    """A is complete, B lacks day 4, C starts on day 6 and has a null count."""
    rows = [("A", t, t * 10) for t in range(1, 11)]
    rows += [("B", t, t) for t in range(1, 11) if t != 4]
    rows += [("C", t, None if t == 8 else t + 100) for t in range(6, 11)]
    return spark.createDataFrame(rows, "e string, t int, y int")


@pytest.fixture(scope="module")
def weather2(spark):
    d1, d2 = dt.date(2022, 1, 5), dt.date(2022, 4, 2)
    rows = [("A", d1, 5.0, None), ("B", d1, 5.0, 40.0), ("C", d1, -1.0, 40.0)]
    rows += [("A", d2, 7.0, 50.0), ("B", d2, 7.0, 51.0), ("C", d2, 7.0, 50.0)]
    return spark.createDataFrame(rows, "e string, date date, wind double, temp double")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_balance_and_incomplete(gap3):
    assert rows(quality.panel_balance(gap3, "e"), "n_rows", "n_entities") == [(5, 1), (9, 1), (10, 1)]
    assert rows(quality.incomplete_entities(gap3, "e", 10), "e") == [("B",), ("C",)]
    assert rows(quality.incomplete_entities(gap3, "e", 9, exact=True), "e") == [("B",)]


@pytest.mark.parametrize("size", [3, 4096])
def test_missing_and_gaps(gap3, size):
    assert rows(quality.missing_times(gap3, "e", "t", 10, size), "e", "t") == [("B", 4)] + [("C", t) for t in range(1, 6)]
    assert rows(quality.gap_runs(gap3, "e", "t", size=size), "e", "gap_start", "gap_end", "gap_len") == [("B", 4, 4, 1)]


def test_consistency_counts_null_as_a_value(weather2):
    out = rows(quality.consistency_check(weather2, "date", ["wind", "temp"]), "column_name", "date", "n_values")
    d1, d2 = dt.date(2022, 1, 5), dt.date(2022, 4, 2)
    assert out == [("temp", d1, 2), ("temp", d2, 2), ("wind", d1, 2)]
    out = rows(quality.consistency_check(weather2, "date", ["wind", "temp"], count_null=False), "column_name", "date")
    assert out == [("temp", d2), ("wind", d1)]


def test_repair(weather2):
    df = quality.fill_from_group(quality.sentinel_to_null(weather2, "wind"), ["wind", "temp"], "date")
    first = df.filter("date = DATE '2022-01-05'")
    assert rows(first.distinct(), "e", "wind", "temp") == [("A", 5.0, 40.0), ("B", 5.0, 40.0), ("C", 5.0, 40.0)]
    assert quality.sentinel_to_null(weather2, "wind").filter("wind IS NULL").count() == 1


@pytest.mark.parametrize("size", [2, 4096])
def test_gap_aware_lags(gap3, size):
    out = lags.gap_aware_lags(gap3, "e", "t", "y", {"l1": 1, "l7": 7}, size)
    got = {(r.e, r.t): (r.l1, r.l7) for r in out.collect()}
    assert len(got) == gap3.count()
    assert got[("B", 5)] == (None, None) and got[("B", 10)] == (9, 3) and got[("C", 9)] == (None, None)
    by_join = lags.gap_aware_lag_by_join(gap3, "e", "t", "y", 7, "l7")
    assert rows(by_join.fillna(-1), "e", "t", "l7") == rows(out.fillna(-1), "e", "t", "l7")


@pytest.mark.parametrize("size", [2, 4096])
def test_observed_lags_and_positions(gap3, size):
    out = lags.observed_lags(gap3, "e", "t", "y", {"l1": 1, "l3": 3}, size)
    got = {(r.e, r.t): (r.l1, r.l3) for r in out.collect()}
    assert got[("B", 5)] == (3, 1) and got[("B", 6)] == (5, 2) and got[("C", 6)] == (None, None)
    pos = {(r.e, r.t): r.pos for r in slices.entity_position(gap3, "e", "t", size=size).collect()}
    assert pos[("C", 6)] == 1 and pos[("B", 10)] == 9


def test_hot_entity_is_split(spark):
    """One entity with a third of all rows ends up in many slices, with the same lags."""
    df = spark.range(30000).select(
        F.when(F.col("id") < 10000, -1).otherwise(F.col("id") % 2000).alias("e"),
        F.when(F.col("id") < 10000, F.col("id")).otherwise(F.floor(F.col("id") / 2000)).cast("int").alias("t"),
        F.col("id").alias("y"),
    )
    halo = slices.with_halo(df, "t", 7, 0, 512).filter("e = -1")
    assert halo.select("_slice").distinct().count() == 20
    assert halo.count() < 10000 * 1.02
    got = slices.drop_halo(halo)
    assert got.count() == 10000
    out = lags.gap_aware_lags(df, "e", "t", "y", {"l7": 7}, 512).filter("e = -1 AND t >= 7")
    assert out.filter("l7 = y - 7").count() == 10000 - 7


def test_donor_rows(gap3, spark):
    donor = spark.createDataFrame([(t, t * 1.5) for t in range(1, 11)], "t int, rain double")
    out = joins.donor_rows(gap3, "e", "t", 10, donor, ["rain"])
    assert rows(out, "e", "t", "rain")[0] == ("B", 4, 6.0)


def test_exact_quantiles_with_ties(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 1, 1, 1, 2, 3, 10]] + [("b", 4), ("b", 8), ("c", None)], "g string, v int")
    out = ranking.exact_quantiles(df, "v", {"q1": 0.25, "m": 0.5, "q3": 0.75}, ["g"])
    assert rows(out, "g", "q1", "m", "q3") == [("a", 1.0, 1.0, 2.5), ("b", 5.0, 6.0, 7.0)]


def test_profile_and_mean_median(gap3):
    p = {r.column_name: r for r in quality.profile(gap3, ["y", "t"]).collect()}
    assert p["y"]["n_null"] == 1 and p["t"]["n_null"] == 0 and p["t"]["max"] == 10.0
    m = {r.e: (r.mean_y, r.median_y) for r in describe.mean_median(gap3, "e", "y").collect()}
    assert m["A"] == (55.0, 55.0) and m["C"][1] == 108.0


def test_rank_positions(spark):
    df = spark.range(1, 101).select(F.format_string("s%03d", F.col("id")).alias("e"), F.col("id").alias("y"))
    ranked = ranking.rank_entities(df, "e", "y")
    assert [r[0] for r in rows(ranking.pick_bottom_middle_top(ranked), "rank")] == [1, 2, 3, 49, 50, 51, 98, 99, 100]
    assert [r[0] for r in rows(ranking.pick_evenly_spaced(ranked, 4), "rank")] == [1, 34, 67, 100]
    nine = [r[0] for r in rows(ranking.sample_entities(df, "e", 9), "rank")]
    assert nine == [1, 13, 26, 38, 50, 63, 75, 88, 100]


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([("k", 1.0, 2.0), ("k", 1.0, 3.0), ("v", 1.0, 2.0), ("v", 2.0, 4.0)], "e string, x double, y double")
    out = {r.e: r.cor for r in describe.correlation(df, "x", "y", ["e"]).collect()}
    assert out["k"] is None and out["v"] == pytest.approx(1.0)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (4.0,), (9.0,)], "v double")
    assert [r.n for r in describe.histogram(df, "v", 0.0, 4.0, 1.0).orderBy("bin").collect()] == [0, 2, 2, 0, 1, 1]
    assert describe.sturges_breaks(0.0, 334.0, 334) == (0.0, 350.0, 50.0)


def test_bands_bins_and_labels(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.11,), (0.3,), (0.31,), (None,)], "v double")
    got = [r[0] for r in df.select(fc.intensity_band(F.col("v"))).collect()]
    assert got == ["non", "light", "moderate", "moderate", "heavy", None]
    df = spark.createDataFrame([(0.0,), (0.999,), (1.0,), (4.0,), (4.1,)], "v double")
    assert [r[0] for r in df.select(fc.cut_bins(F.col("v"), [0, 1, 2, 3, 4.1])).collect()] == [1, 1, 2, 4, None]


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2022, 1, 1),), (dt.date(2022, 8, 28),), (None,)], "date date")
    out = cal.add_flags(
        cal.add_calendar(df).withColumn("mean_temperature", F.lit(32.0)),
    ).collect()
    assert (out[0].weekday, out[0].month, out[0].IsWeekend, out[0].JanuarySlope, out[0].IsSummerHoliday) == ("Samstag", 1, 1.0, 1.0, 0.0)
    assert out[1].IsSummerHoliday == 1.0 and out[1].IsFreezing == 1.0 and out[2].IsWeekend is None
    assert cal.WEEKDAY_BASE == "Dienstag"


def test_half_even_rounding(spark):
    r = spark.range(1).select(F.bround(F.lit(0.125), 2).alias("a"), F.bround(F.lit(2.5), 0).alias("b")).first()
    assert (r.a, r.b) == (0.12, 2.0)


def test_row_key(spark):
    r = spark.range(1).select(fc.entity_of_row_key(F.lit("10th & E St-West-2022-01-05"))).first()
    assert r[0] == "10th & E St-West"


def test_gap_runs_with_ends_cover_all_missing_times(gap3):
    runs = rows(quality.gap_runs(gap3, "e", "t", 12), "e", "gap_start", "gap_end", "gap_len")
    missing = quality.missing_times(gap3, "e", "t", 12).count()
    assert sum(r[3] for r in runs) == missing
    assert ("C", 1, 5, 5) in runs and ("A", 11, 12, 2) in runs


def test_unlisted_level_is_an_error(spark):
    from pyspark.errors import PySparkException

    from panelkit.functions.columns import one_hot

    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    out, names = one_hot(df, "x", ["a", "b"])
    assert names == ["x_b"] and sorted(r["x_b"] for r in out.filter("x_b is not null").collect()) == [0.0, 1.0]
    with pytest.raises(PySparkException):
        one_hot(df, "x", ["a", "c"])[0].collect()


def test_csv_with_another_header_or_bad_values_is_an_error(spark, tmp_path):
    from pyspark.sql import types as T

    from panelkit.sources.panels import read_panel_csv

    schema = T.StructType([T.StructField("station", T.StringType()), T.StructField("count", T.LongType())])
    for name, parts in {"order": ["station,count\nA,1\n", "count,station\n7,C\n"], "value": ["station,count\nA,x2\n"], "good": ["station,count\nA,1\n", "station,count\nB,NA\n"]}.items():
        (tmp_path / name).mkdir()
        for k, text in enumerate(parts):
            (tmp_path / name / f"{k}.csv").write_text(text)
    assert sorted(r["station"] for r in read_panel_csv(spark, str(tmp_path / "good"), schema).collect()) == ["A", "B"]
    for name in ("order", "value"):
        with pytest.raises(Exception, match="header does not conform|[Mm]alformed"):
            read_panel_csv(spark, str(tmp_path / name), schema).collect()


def test_lags_after_a_join_are_dealt_by_slice(spark):
    """A join leaves rows dealt by entity; the slices must still go to tasks of their own."""
    from panelkit.operators.lags import gap_aware_lags

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(100).selectExpr("id % 3 AS e", "id AS t", "id AS y")
        right = spark.range(3).selectExpr("id AS e", "id AS fe")
        plan = gap_aware_lags(left.join(right, "e"), "e", "t", "y", {"l": 1})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "_slice" in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
