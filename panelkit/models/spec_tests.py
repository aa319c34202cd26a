"""Specification tests. Each returns one row: statistic, df1, df2, p_value."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from ..operators.lags import gap_aware_lags
from .gram import solve_spd
from .lag_products import lag_products
from .linear import LinearFit, demean, ols_pooled

_SCHEMA = "statistic double, df1 double, df2 double, p_value double"


def _row(spark: SparkSession, stat: float, df1: float, df2: float | None, p: float) -> DataFrame:
    return spark.createDataFrame([(float(stat), float(df1), None if df2 is None else float(df2), float(p))], _SCHEMA)


def _f_test(spark, rss0: float, df0: float, rss1: float, df1: float) -> DataFrame:
    f = ((rss0 - rss1) / (df0 - df1)) / (rss1 / df1)
    return _row(spark, f, df0 - df1, df1, dist.f_upper(f, df0 - df1, df1))


def f_test_nested(restricted: LinearFit, full: LinearFit) -> DataFrame:
    """Pooled against within, or two nested within models."""
    return _f_test(full.sample.sparkSession, restricted.rss, restricted.df_resid, full.rss, full.df_resid)


def chow_poolability(restricted: LinearFit, by_entity: DataFrame) -> DataFrame:
    """Pooled or within model against one regression per entity."""
    r = by_entity.agg(F.sum("rss"), F.sum(F.when(F.col("rss").isNotNull(), F.col("df_resid")))).first()
    return _f_test(restricted.sample.sparkSession, restricted.rss, restricted.df_resid, float(r[0]), float(r[1]))


def _residual_sums(scored: DataFrame, entity: str):
    ent = scored.groupBy(entity).agg(
        F.sum("resid").alias("u"), F.sum(F.col("resid") * F.col("resid")).alias("uu"),
        F.count(F.lit(1)).cast("double").alias("T"),
    )
    w = (F.col("u") * F.col("u") - F.col("uu")) / 2
    return ent.agg(
        F.sum(F.col("u") * F.col("u")).alias("u2"), F.sum("uu").alias("uu"), F.sum("T").alias("N"),
        F.sum(F.col("T") * F.col("T")).alias("T2"), F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("W"), F.sum(w * w).alias("W2"),
    ).first()


def breusch_pagan_lm(pooled: LinearFit, entity: str) -> DataFrame:
    """Lagrange multiplier test for entity effects, unbalanced form."""
    s = _residual_sums(pooled.scored(), entity)
    a = 1 - s["u2"] / s["uu"]
    lm = s["N"] ** 2 / 2 * a * a / (s["T2"] - s["N"])
    return _row(pooled.sample.sparkSession, lm, 1, None, dist.chi2_upper(lm, 1))


def wooldridge_effects(pooled: LinearFit, entity: str) -> DataFrame:
    """Test for unobserved effects from cross products of residuals within entities."""
    s = _residual_sums(pooled.scored(), entity)
    z = s["W"] / math.sqrt(s["W2"])
    return _row(pooled.sample.sparkSession, z, 1, None, dist.normal_two_sided(z))


def locally_robust_ar1(pooled: LinearFit, entity: str, t: str) -> DataFrame:
    """AR(1) test robust to entity effects (Bera, Sosa-Escudero and Yoon 2001; unbalanced 2008).

    The published form has N - n neighbouring pairs. With gaps there are fewer
    pairs one time step apart; their number takes that place, which keeps both
    the robustness to entity effects and the variance of the statistic.
    """
    sc = pooled.scored().select(entity, t, "resid")
    s = _residual_sums(sc, entity)
    lagged = gap_aware_lags(sc, entity, t, "resid", {"u1": 1})
    pairs = lagged.agg(F.sum(F.col("resid") * F.col("u1")).alias("cross"), F.count("u1").alias("p")).first()
    n_obs, p = s["N"], float(pairs["p"])
    a, b = 1 - s["u2"] / s["uu"], pairs["cross"] / s["uu"]
    c = p / (s["T2"] - n_obs)
    lm = n_obs**2 * (b + c * a) ** 2 / (p * (1 - 2 * c))
    return _row(pooled.sample.sparkSession, lm, 1, None, dist.chi2_upper(lm, 1))


def wooldridge_ar1(fit: LinearFit, t: str) -> DataFrame:
    """Slope of the within residual on its lag against -1/(T-1), entity-clustered.

    T is the mean number of rows per entity.
    """
    aux = _residual_on_lag(fit, t, 1)
    dev = F.col("u_lag") - F.lit(aux.means["u_lag"])  # the mean over the sample
    sums = aux.scored().groupBy(fit.entity).agg(F.sum(dev * F.col("resid")).alias("s"))
    meat = sums.agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    se = float(aux.bread[0, 0]) * math.sqrt(meat)
    stat = ((float(aux.beta[1]) - _ar_delta(fit)) / se) ** 2
    df2 = fit.n_entities - 1
    aux.release()
    return _row(fit.sample.sparkSession, stat, 1, df2, dist.f_upper(stat, 1, df2))


def _ar_delta(fit: LinearFit) -> float:
    return -1 / (fit.n / fit.n_entities - 1)


def _residual_on_lag(fit: LinearFit, t: str, k: int, square: bool = False) -> LinearFit:
    u = fit.scored().select(fit.entity, t, F.col("resid").alias("u"))
    rows = gap_aware_lags(u, fit.entity, t, "u", {"u_lag": k})
    xs = ["u_lag"]
    if square:
        rows, xs = rows.withColumn("u_lag_sq", F.col("u_lag") * F.col("u_lag")), ["u_lag", "u_lag_sq"]
    return ols_pooled(rows, "u", xs, [fit.entity, t])


def manual_ar_check(fit: LinearFit, t: str, k: int = 1, square: bool = False, delta: float | None = None) -> DataFrame:
    """t = (delta - slope) / se from the residual's regression on its lag (and its square)."""
    aux = _residual_on_lag(fit, t, k, square)
    d = _ar_delta(fit) if delta is None else delta
    stat = (d - float(aux.beta[1])) / math.sqrt(float(aux.vcov[1, 1]))
    aux.release()
    return _row(fit.sample.sparkSession, stat, aux.df_resid, None, dist.t_two_sided(stat, aux.df_resid))


def breusch_godfrey(fit: LinearFit, t: str, order: int | None = None) -> DataFrame:
    """N R2 of the within residual on the demeaned covariates and its lags.

    Lags without a row count as zero. The default order is the fewest rows of an
    entity; the products of all lags come from one pass over the rows.
    """
    if order is None:
        order = int(fit.fixef.agg(F.min("n_i")).first()[0])
    if order < 1:
        raise ValueError("order must be at least 1")
    names = [f"{x}_dm" for x in fit.xs]
    rows = demean(fit.scored().select(fit.entity, t, *fit.xs, "resid"), fit.entity, fit.xs)
    c = lag_products(rows, fit.entity, t, "resid", names, order)
    k = len(c) - 1
    stat = fit.n * float(c[:k, k] @ solve_spd(c[:k, :k], c[:k, k])) / float(c[k, k])
    return _row(fit.sample.sparkSession, stat, order, None, dist.chi2_upper(stat, order))
