"""The whole analysis of daily station counts with weather, from raw table to prediction.

Column names are those of ``sources.panels.RAW_PANEL_SCHEMA``. Every step is a
function from DataFrame to DataFrame (or to a fit), so that steps can be
replaced; model fits run jobs, all else is lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.columns import add_quadratic, guarded_log, one_hot
from ..models import glm, linear
from ..operators import lags, quality, smooth
from ..sources.panels import attach_axis, time_axis
from . import impute, predict

ENTITY, DATE, T, Y = "station", "date", "obs_count", "count"
# Covariates of the models and the month to be imputed.
WEATHER = ["wind_speed", "precipitation", "snowfall", "snow_depth", "mean_temperature"]
WEEK_LAG = "adj_lagged_count_by_week"
BAD_MONTH = 8


def clean(raw: DataFrame) -> DataFrame:
    """Wind sentinel to null, then wind and temperature filled from the other stations of the day."""
    return quality.fill_from_group(quality.sentinel_to_null(raw, "wind_speed"), ["wind_speed", "mean_temperature"], DATE)


def add_time(panel: DataFrame) -> DataFrame:
    """Month, day, weekday, the day ordinal and the flags."""
    panel = attach_axis(cal.add_calendar(panel, DATE), time_axis(panel, DATE, T), DATE)
    return cal.add_flags(panel, DATE)


def add_lags(panel: DataFrame) -> DataFrame:
    """Gap-aware and observed lags of one day and one week."""
    panel = lags.gap_aware_lags(panel, ENTITY, T, Y, {"adj_lagged_count": 1, WEEK_LAG: 7})
    return lags.observed_lags(panel, ENTITY, T, Y, {"lagged_count": 1, "lagged_count_by_week": 7})


def without_bad_month(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("month") != BAD_MONTH)


def months_of(panel: DataFrame) -> list[int]:
    """The months of the panel, twelve at most."""
    return sorted(r["month"] for r in panel.select("month").distinct().collect())


def model_frame(panel: DataFrame, levels: list[int] | None = None) -> tuple[DataFrame, list[str], list[str], list[str]]:
    """Derived regressors; returns the frame, weather, weekday and month terms (against the first of ``levels``)."""
    df = add_quadratic(panel, "mean_temperature", "mean_temperature_sq")
    df = df.withColumns({"log_count": guarded_log(F.col(Y)), "log_week_lag": guarded_log(F.col(WEEK_LAG))})
    df, weekdays = one_hot(df, "weekday", cal.WEEKDAY_LEVELS, cal.WEEKDAY_BASE)
    df, months = one_hot(df, "month", months_of(panel) if levels is None else levels)
    return df, [*WEATHER, "mean_temperature_sq"], weekdays, months


def fit_log_counts(panel: DataFrame) -> linear.LinearFit:
    """Within model of log counts: weather, months, weekdays, freezing and log weekly lag (24 columns)."""
    df, weather, weekdays, months = model_frame(panel)
    xs = [*weather, *months, *weekdays, "IsFreezing", "log_week_lag"]
    return linear.within(df, "log_count", xs, ENTITY, [T, DATE])


def fit_counts(panel: DataFrame) -> glm.PoissonFit:
    """Poisson model with station and month effects, weather, weekdays, freezing and weekly lag."""
    panel = without_bad_month(panel)
    present = months_of(panel)
    df, weather, weekdays, months = model_frame(panel, present)
    df = df.drop(*months)
    return glm.poisson_fe(df, Y, [*weather, *weekdays, "IsFreezing", WEEK_LAG], ENTITY, "month", present, [T])


def day_table(panel: DataFrame, fit: glm.PoissonFit) -> DataFrame:
    """One row per day with the covariates and the effect of its month.

    In the bad month the effect comes from the spline through the other months.
    """
    df, weather, weekdays, _ = model_frame(panel)
    terms = [*weather, *weekdays, "IsFreezing"]
    days = df.groupBy(T, "month", "day").agg(*[F.max(c).alias(c) for c in terms])
    known = F.lit(None).cast("double")
    for m, e in fit.month_effects.items():
        known = F.when(F.col("month") == m, F.lit(e)).otherwise(known)
    spline = smooth.month_effect_spline(panel.sparkSession, fit.month_effects, BAD_MONTH)
    days = days.join(F.broadcast(spline.select("day", F.col("effect").alias("_s"))), "day", "left")  # 31 rows
    effect = F.when(F.col("month") == BAD_MONTH, F.col("_s")).otherwise(known)
    return days.withColumn("effect", effect).drop("_s")


def impute_bad_month(
    panel: DataFrame, fit: glm.PoissonFit, draw: str = "poisson", seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """The panel with imputed counts and renewed lags, and the rows that could not be imputed."""
    r = panel.filter(F.col("month") == BAD_MONTH).agg(F.min(T).alias("a"), F.max(T).alias("b")).first()
    terms = {t: b for t, b in fit.slopes.items() if t in fit.covariates and t != WEEK_LAG}
    model = impute.CountModel(terms, fit.slopes[WEEK_LAG], fit.fixef)
    new, rejected = impute.impute_period(
        panel, day_table(panel, fit), model, ENTITY, T, Y, r["a"], r["b"], draw=draw, seed=seed
    )
    done = impute.apply_imputation(panel.drop(WEEK_LAG, "adj_lagged_count"), new, ENTITY, T, Y, rejected)
    done = lags.gap_aware_lags(done, ENTITY, T, Y, {"adj_lagged_count": 1, WEEK_LAG: 7})
    return done, rejected


def rank_stations(fit: linear.LinearFit, coords: DataFrame) -> DataFrame:
    """Coordinates with the station effect, rescaled, layered and rounded."""
    return predict.rescale_effects(coords.join(fit.fixef.select(ENTITY, "fe"), ENTITY, "left"))


def temperature_sweep(panel: DataFrame, fit: linear.LinearFit, station: str, month: int = BAD_MONTH, n: int = 640) -> DataFrame:
    """Predicted counts of a station from 10 to 90 degrees Fahrenheit.

    Wind, rain and the weekly lag are the station's means in the month; weekday,
    snow and month are those of its first day there. The freezing flag follows
    the temperature.
    """
    rows, *_ = model_frame(panel.filter((F.col(ENTITY) == station) & (F.col("month") == month)), months_of(panel))
    means = {c: rows.agg(F.avg(c)).scalar() for c in ("wind_speed", "precipitation")}
    lag = rows.agg(F.avg(WEEK_LAG)).scalar()
    first = rows.orderBy(T).limit(1).withColumns({**means, "log_week_lag": F.ln(lag)})

    def derive(g: DataFrame) -> DataFrame:
        temp = F.col("mean_temperature")
        return g.withColumns(
            {"mean_temperature_sq": temp * temp, "IsFreezing": cal.flag(temp <= cal.FREEZING_F)}
        )

    return predict.scenario_sweep(first, fit, "mean_temperature", 10.0, 90.0, n, derive)
