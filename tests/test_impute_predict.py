import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions.columns import hash_uniform, poisson_draw
from panelkit.models import linear
from panelkit.plans import impute, predict
from panelkit.sources import panels


@pytest.fixture(scope="module")
def wave(spark):
    """Days 22-35 are to be imputed; gaps before them exercise every fallback."""
    rng = np.random.default_rng(5)
    gone = {"full": set(), "null1": set(), "gap1": {15}, "gap2": {15, 8}, "gap3": {15, 8, 1}, "hole": {24}}
    rows = []
    for e, miss in gone.items():
        for t in range(1, 43):
            if t in miss:
                continue
            y = None if e == "null1" and t == 16 else int(rng.poisson(9))
            rows.append((e, t, y))
    panel = spark.createDataFrame(rows, "e string, t int, y int")
    days = [(t, round(float(rng.normal(0, 0.2)), 4), 0.1 if t < 22 else 0.01 * t) for t in range(1, 43)]
    effects = {e: 1.5 + i / 10 for i, e in enumerate(gone)}
    model = impute.CountModel({"rain": -0.5}, 0.04, spark.createDataFrame(list(effects.items()), "e string, fe double"))
    return panel, spark.createDataFrame(days, "t int, rain double, effect double"), model, rows, days, effects


def sequential(rows, days, effects, draw):
    """Day after day, entity after entity: what the chained columns must equal."""
    y = {(e, t): v for e, t, v in rows}
    day = {t: (r, f) for t, r, f in days}

    def lam(e, t, lag):
        if lag is None or t not in day:
            return None
        return math.exp(-0.5 * day[t][0] + day[t][1] + effects[e] + 0.04 * lag)

    def get(k):
        return y.get(k)

    out, bad = {}, set()
    for e in effects:
        for t in range(22, 36):
            if (e, t) not in y:
                continue
            lag = get((e, t - 7))
            if lag is None:
                lag2 = get((e, t - 14))
                if lag2 is None:
                    lag2 = draw(e, t, "back2", lam(e, t - 14, get((e, t - 21))))
                lag = draw(e, t, "back1", lam(e, t - 7, lag2))
            m = lam(e, t, lag)
            y[(e, t)] = draw(e, t, "day", m)
            if m is None:
                bad.add((e, t))
            else:
                out[(e, t)] = (m, y[(e, t)])
    return out, bad


def test_waves_equal_the_sequential_loop(wave):
    panel, days, model, rows, day_rows, effects = wave
    want, bad = sequential(rows, day_rows, effects, lambda e, t, kind, m: m)
    out, rej = impute.impute_period(panel, days, model, "e", "t", "y", 22, 35, draw="expected")
    got = {(r.e, r.t): (r["lambda"], r.y_imputed) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert {(r.e, r.t) for r in rej.collect()} == bad == {("gap3", 22), ("gap3", 29)}
    assert ("hole", 24) not in got and ("hole", 31) in got


def test_poisson_waves_equal_the_sequential_loop(wave, spark):
    panel, days, model, rows, day_rows, effects = wave
    keys = spark.createDataFrame([(e, t, k) for e in effects for t in range(22, 36) for k in ("day", "back1", "back2")], "e string, t int, k string")
    u = {(r.e, r.t, r.k): r.u for r in keys.withColumn("u", hash_uniform(F.col("e"), F.col("t"), F.lit(3), F.col("k"))).collect()}

    def draw(e, t, kind, m):
        if m is None:
            return None
        k, p = 0, math.exp(-m)
        c = p
        while c < u[(e, t, kind)]:
            k += 1
            p *= m / k
            c += p
        return k

    want, _ = sequential(rows, day_rows, effects, draw)
    out, _ = impute.impute_period(panel, days, model, "e", "t", "y", 22, 35, draw="poisson", seed=3)
    got = {(r.e, r.t): r.y_imputed for r in out.collect()}
    assert got == {k: float(v[1]) for k, v in want.items()}
    again, _ = impute.impute_period(panel.repartition(5), days, model, "e", "t", "y", 22, 35, draw="poisson", seed=3)
    assert {(r.e, r.t): r.y_imputed for r in again.collect()} == got


def test_plan_does_not_grow_with_the_period(spark):
    """Planning 52 weeks takes about as long as planning 2, and all weeks are there."""
    import time

    panel = spark.range(14 * 400).selectExpr("cast(id % 14 as int) e", "cast(id div 14 as int) t", "cast(1 + id % 5 as double) y")
    days = panel.select("t").distinct().selectExpr("t", "0.01 * (t % 3) as rain", "0.0 as effect")
    model = impute.CountModel({"rain": 0.1}, 0.02, panel.select("e").distinct().selectExpr("e", "0.5 as fe"))

    def planned(weeks):
        start = time.perf_counter()
        out, _ = impute.impute_period(panel, days, model, "e", "t", "y", 30, 29 + 7 * weeks)
        size = len(out._jdf.queryExecution().optimizedPlan().toString())
        return time.perf_counter() - start, size, out

    planned(2)
    two, fifty = planned(2), planned(52)
    assert fifty[0] < 1.5 * two[0] + 0.5 and fifty[1] < 1.1 * two[1]
    assert fifty[2].count() == 14 * 52 * 7


def test_apply_imputation_renews_rows(wave):
    panel, days, model, *_ = wave
    out, _ = impute.impute_period(panel, days, model, "e", "t", "y", 22, 35, draw="expected")
    new = impute.apply_imputation(panel, out, "e", "t", "y")
    assert new.count() == panel.count()
    assert new.filter("is_imputed").count() == out.count()
    assert new.filter("NOT is_imputed AND t BETWEEN 22 AND 35").count() == 2  # the rejected rows
    cmp = impute.compare_periods(panel, new, "e", "t", "y").filter("e = 'full'").orderBy("is_imputed").collect()
    assert [r.n for r in cmp] == [28, 14] and cmp[0].mean_raw == cmp[0].mean_imputed


def test_draw_argument_is_checked(wave):
    panel, days, model, *_ = wave
    with pytest.raises(ValueError):
        impute.impute_period(panel, days, model, "e", "t", "y", 22, 35, draw="median")


@pytest.mark.parametrize("lam", [0.3, 7.3, 300.0, 2000.0])
def test_poisson_draw_moments(spark, lam):
    df = spark.range(8000).select(poisson_draw(F.lit(lam), hash_uniform(F.col("id"), F.lit(1))).alias("k"))
    r = df.agg(F.avg("k").alias("m"), F.var_samp("k").alias("v")).first()
    assert r.m == pytest.approx(lam, abs=4 * math.sqrt(lam / 8000)) and r.v == pytest.approx(lam, rel=0.08)


@pytest.fixture(scope="module")
def fit(spark):
    rng = np.random.default_rng(11)
    rows = [(f"s{i}", t, float(rng.normal()), float(rng.normal()), 0.0) for i in range(6) for t in range(30)]
    rows = [(e, t, a, b, 1 + int(e[1]) / 5 + 0.3 * a - 0.2 * b + float(rng.normal(0, 0.1 * (1 + int(e[1]))))) for e, t, a, b, _ in rows]
    df = spark.createDataFrame(rows, "e string, t int, a double, b double, ly double")
    return linear.within(df, "ly", ["a", "b"], "e", ["t"]), df


def test_forecast_contains_prediction_interval(fit):
    model, df = fit
    p = predict.interval(df, model)
    f = predict.interval(df, model, "forecast").select("e", "t", F.col("lower").alias("fl"), F.col("upper").alias("fu"))
    both = p.join(f, ["e", "t"])
    assert both.filter("fl < lower AND lower < prediction AND prediction < upper AND upper < fu").count() == df.count()
    wide = predict.interval(df, model, alpha=0.01).agg(F.avg(F.col("upper") - F.col("lower"))).first()[0]
    assert wide > p.agg(F.avg(F.col("upper") - F.col("lower"))).first()[0]


def test_specific_sigma_and_smearing(fit):
    model, df = fit
    s = model.scored().filter("e = 's5'").agg(F.avg(F.exp("resid")).alias("a"), F.avg(F.col("resid") ** 2).alias("s2")).first()
    d = predict.interval(df, model, "forecast").filter("e = 's5' AND t = 0").first()
    o = predict.interval(df, model, "forecast", "specific", "specific").filter("e = 's5' AND t = 0").first()
    a0 = predict.smearing_factor(model).first()[0]
    assert o.prediction / d.prediction == pytest.approx(s.a / a0)
    assert math.log(o.upper / o.prediction) > math.log(d.upper / d.prediction)


def test_squared_mode_is_an_option(fit):
    model, df = fit
    a = predict.interval(df, model, v_mode="squared").filter("e = 's1' AND t = 3").first()
    x = np.array([a.a, a.b])
    se = math.sqrt(x @ model.vcov.T @ model.vcov @ x)
    from panelkit.functions.dist import t_quantile

    assert math.log(a.upper / a.prediction) == pytest.approx(t_quantile(0.975, 30 - 3) * se, rel=1e-9)


@pytest.mark.parametrize("kw", [{"type": "confidence"}, {"sigma": "mine"}, {"smearing": "all"}, {"v_mode": "x"}])
def test_interval_arguments(fit, kw):
    model, df = fit
    with pytest.raises(ValueError):
        predict.interval(df, model, **kw)


def test_interval_needs_the_entity(fit):
    model, df = fit
    with pytest.raises(ValueError):
        predict.interval(df.drop("e"), model)


def test_scenario_sweep_switches_the_flag(spark):
    rng = np.random.default_rng(4)
    rows = [(e, t, float(rng.uniform(10, 90))) for e in ("a", "b") for t in range(60)]
    rows = [(e, t, x, x * x, 1.0 if x <= 32 else 0.0, float(2 + 0.02 * x - 0.0001 * x * x + rng.normal(0, 0.1))) for e, t, x in rows]
    df = spark.createDataFrame(rows, "e string, t int, temp double, temp2 double, cold double, ly double")
    m = linear.within(df, "ly", ["temp", "temp2", "cold"], "e", ["t"])

    def derive(g):
        return g.withColumns({"temp2": F.col("temp") * F.col("temp"), "cold": (F.col("temp") <= 32).cast("double")})

    out = predict.scenario_sweep(df.filter("e = 'a'").limit(1), m, "temp", 10, 90, 640, derive).orderBy("temp").collect()
    assert len(out) == 640 and out[0].temp == 10 and out[-1].temp == 90
    assert all(r.lower_forecast < r.lower < r.prediction < r.upper < r.upper_forecast for r in out)


def test_rescaled_effects(spark):
    # published values of five stations, with the lowest and the highest effect
    fe = [0.218415756355055, 0.316632335632665, 0.407102189773215, 0.5038491951255, 1.25059295568045]
    df = spark.createDataFrame([(f"s{i}", v) for i, v in enumerate(fe)], "station string, fe double")
    out = predict.rescale_effects(df).orderBy("station").collect()
    assert [r.scaled_fe for r in out] == pytest.approx([0, 0.380619061695228, 0.731217211701557, 1.10614122829683, 4], abs=1e-12)
    assert [r.layer for r in out] == [1, 1, 1, 2, 4]
    assert [r.round_fe for r in out] == [0.218, 0.317, 0.407, 0.504, 1.251]
    assert [r.round_scaled_fe for r in out] == [0.0, 0.381, 0.731, 1.106, 4.0]
    assert [r.station for r in predict.rank_effects(df, "station", 2).collect()] == ["s4", "s3"]
    assert [r.station for r in predict.rank_effects(df, "station", 2, top=False).collect()] == ["s0", "s1"]


def test_csv_round_trip_with_na(spark, tmp_path):
    rows = [("A, B", dt.date(2022, 1, 5), None, 5.0), ("C", dt.date(2022, 1, 6), 7, None)]
    df = spark.createDataFrame(rows, "station string, date date, count int, wind_speed double")
    path = str(tmp_path / "panel")
    # the column order of the file differs from the schema's
    panels.write_panel(df.select("date", "wind_speed", "count", "station"), path, "csv")
    back = panels.read_panel_csv(spark, path, df.schema)
    assert back.columns == df.columns
    assert sorted(back.collect()) == sorted(df.collect())
    panels.write_panel(df, str(tmp_path / "pq"), partition_by=["count"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_overrides(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    lookup = spark.createDataFrame([("a", 1.0)], "s string, lat double")
    hand = spark.createDataFrame([("b", 2.0)], "s string, lat double")
    out, miss = panels.enrich_with_overrides(keys, lookup, hand, "s", ["lat"])
    assert {r.s: r.lat for r in out.collect()} == {"a": 1.0, "b": 2.0, "c": None}
    assert {r.s for r in miss.collect()} == {"b", "c"}


def test_axis_of_timestamps_is_ranked(spark):
    df = spark.createDataFrame([(dt.datetime(2022, 1, 1, h),) for h in (5, 3, 5, 9)], "ts timestamp")
    assert [(r.ts.hour, r.t) for r in panels.time_axis(df, "ts").orderBy("t").collect()] == [(3, 1), (5, 2), (9, 3)]
