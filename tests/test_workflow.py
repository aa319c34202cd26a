"""The complete analysis on a simulated year of eleven months."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions.calendar import WEEKDAYS
from panelkit.models import linear, robust
from panelkit.operators import quality
from panelkit.plans import workflow as wf
from panelkit.sources import panels


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    rng = np.random.default_rng(2022)
    start = dt.date(2022, 1, 1)
    rows = []
    count = {}
    for t in range(334):
        d = start + dt.timedelta(days=t)
        temp = 55 - 30 * math.cos(2 * math.pi * t / 365) + rng.normal(0, 6)
        rain = max(0.0, rng.normal(-0.2, 0.4))
        snow = max(0.0, rng.normal(0, 1)) if temp < 34 else 0.0
        wind = max(0.0, rng.normal(8, 3))
        for i in range(8):
            lag = count.get((i, t - 7), 20)
            eta = 1.6 + 0.15 * i + 0.03 * temp - 0.0002 * temp**2 - 0.3 * rain - 0.02 * wind + 0.004 * lag
            eta += 0.1 * (d.weekday() >= 5) + 0.05 * math.sin(d.month)
            y = int(rng.poisson(math.exp(eta))) + 1
            count[(i, t)] = y
            if i == 3 and 100 <= t < 103 or i == 5 and t in (205, 198):
                continue
            if d.month == 8:
                y = 3 * y
            rows.append(
                (f"St {i}", d, None if (i * 37 + t) % 301 == 0 else y, -1.0 if (i, t) == (2, 91) else round(wind, 2),
                 round(rain, 2), round(snow, 2), round(snow / 2, 2), None if (i, t) == (1, 4) else round(temp, 1),
                 round(temp + 8, 1), round(temp - 8, 1))
            )
    path = str(tmp_path_factory.mktemp("raw") / "csv")
    panels.write_panel(spark.createDataFrame(rows, panels.RAW_PANEL_SCHEMA), path, "csv")
    return panels.read_panel_csv(spark, path, panels.RAW_PANEL_SCHEMA)


@pytest.fixture(scope="module")
def features(raw):
    return wf.add_lags(wf.add_time(wf.clean(raw))).persist()


def test_cleaning_removes_every_conflict(raw, features):
    weather = panels.RAW_PANEL_SCHEMA.names[3:]
    before = {(r.column_name, str(r.date)) for r in quality.consistency_check(raw, "date", weather).collect()}
    assert before == {("wind_speed", "2022-04-02"), ("mean_temperature", "2022-01-05")}
    assert quality.consistency_check(features, "date", weather).count() == 0
    assert features.count() == raw.count()
    assert features.agg(F.max("obs_count")).first()[0] == 334


def test_lags_respect_the_gap(features):
    got = {r.obs_count: r for r in features.filter("station = 'St 3' AND obs_count BETWEEN 104 AND 112").collect()}
    assert got[104].adj_lagged_count is None and got[104].lagged_count is not None
    assert got[108].adj_lagged_count_by_week is None and got[111].adj_lagged_count_by_week == got[104]["count"]


def test_impute_refit_predict(spark, features):
    clean = wf.add_lags(wf.without_bad_month(features).drop("adj_lagged_count", "adj_lagged_count_by_week", "lagged_count", "lagged_count_by_week"))
    counts = wf.fit_counts(clean)
    assert counts.last_step < 1e-8 and len(counts.month_effects) == 10
    assert counts.slopes["adj_lagged_count_by_week"] == pytest.approx(0.004, abs=0.003)
    first = wf.fit_log_counts(clean)
    assert len(first.xs) == 23  # no column for the left-out month
    done, rejected = wf.impute_bad_month(features, counts)
    assert rejected.count() == 0
    done = done.persist()
    assert done.count() == features.count()
    august = done.filter("month = 8")
    assert august.filter("NOT is_imputed").count() == 0
    raw_mean = features.filter("month = 8").agg(F.avg("count")).first()[0]
    new_mean = august.agg(F.avg("count")).first()[0]
    assert new_mean == pytest.approx(raw_mean / 3, rel=0.15)
    # the first week after the period looks back at imputed counts
    sep = done.filter("station = 'St 0' AND date = DATE '2022-09-03'").first()
    aug = done.filter("station = 'St 0' AND date = DATE '2022-08-27'").first()
    assert sep.adj_lagged_count_by_week == aug["count"] and aug.is_imputed

    final = wf.fit_log_counts(done)
    assert len(final.xs) == 24 and set(WEEKDAYS[2:]) < {x.removeprefix("weekday_") for x in final.xs}
    fe = [r.fe for r in final.fixef.orderBy("station").collect()]
    assert fe == sorted(fe)
    assert linear.compare_fixef(first.fixef, final.fixef, "station").agg(F.max("abs_diff")).first()[0] < 0.6
    assert np.all(np.diag(robust.vcov_arellano(final)) > 0)

    coords = spark.createDataFrame([(f"St {i}", float(i), -float(i)) for i in range(8)], "station string, long double, lat double")
    ranked = wf.rank_stations(final, coords).orderBy("station").collect()
    assert ranked[0].scaled_fe == 0 and ranked[-1].scaled_fe == pytest.approx(4) and ranked[-1].layer == 4

    sweep = wf.temperature_sweep(done, final, "St 7", n=64).orderBy("mean_temperature").collect()
    assert len(sweep) == 64
    assert all(r.lower_forecast < r.lower < r.prediction < r.upper < r.upper_forecast for r in sweep)
    assert sweep[50].prediction > sweep[5].prediction
