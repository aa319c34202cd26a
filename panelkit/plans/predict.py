"""Predictions with intervals, scenario sweeps and effect rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import add_coef_terms, cut_bins, quadratic_form
from ..models.glm import PoissonFit
from ..models.linear import LinearFit
from ..operators.joins import scenario_grid


def smearing_factor(fit: LinearFit, by_entity: bool = False) -> DataFrame:
    """Mean of exp(residual), overall (one row) or per entity."""
    s = fit.scored()
    g = s.groupBy(fit.entity) if by_entity else s
    return g.agg(F.avg(F.exp("resid")).alias("smearing"))


def predict_smeared(df: DataFrame, fit: LinearFit) -> DataFrame:
    """exp(x'b + FE) times the overall smearing factor; null for an unknown entity."""
    out = df.join(fit.fixef.select(fit.entity, "fe"), fit.entity, "left")
    alpha = smearing_factor(fit).scalar()
    return out.withColumn("prediction", F.exp(add_coef_terms(fit.slopes) + F.col("fe")) * alpha).drop("fe")


def predict_poisson(df: DataFrame, fit: PoissonFit) -> DataFrame:
    """Mean of the Poisson model on the response scale."""
    out = df.join(fit.fixef.select(fit.entity, "fe"), fit.entity, "left")
    return out.withColumn("prediction", F.exp(add_coef_terms(fit.slopes) + F.col("fe"))).drop("fe")


def _critical_values(dfs: DataFrame, alpha: float) -> DataFrame:
    """t quantile for each distinct number of degrees of freedom."""
    p = 1 - alpha / 2

    def quantiles(batches):
        for b in batches:
            yield b.assign(t_crit=dist.t_quantiles(p, b["df"].to_numpy()))

    return dfs.select("df").distinct().mapInPandas(quantiles, "df bigint, t_crit double")


def _choices(**chosen: tuple[str, tuple[str, ...]]) -> None:
    for name, (value, allowed) in chosen.items():
        if value not in allowed:
            raise ValueError(f"{name} must be one of {allowed}, got {value!r}")


def _with_statistics(df: DataFrame, fit: LinearFit, alpha: float, v_mode: str) -> DataFrame:
    """Rows with what every kind of interval is made of.

    ``_eta`` x'b + FE, ``_q`` x'Vx, ``_t`` critical value, and the entity's own
    residual variance ``_s2`` and smearing factor ``_al``.
    """
    _choices(v_mode=(v_mode, ("vcov", "squared")))
    if fit.entity not in df.columns:
        raise ValueError(f"the input needs the entity column {fit.entity!r}")
    r = F.col("resid")
    per = fit.scored().groupBy(fit.entity).agg(
        F.max("fe").alias("_fe"),  # constant in the entity
        F.count(F.lit(1)).alias("_n"),
        F.avg(r * r).alias("_s2"),
        F.avg(F.exp(r)).alias("_al"),
    )
    per = per.withColumn("df", F.col("_n") - len(fit.xs) - 1)
    per = per.join(_critical_values(per, alpha), "df")
    per = per.select(fit.entity, "_fe", "_s2", "_al", F.when(F.col("df") > 0, F.col("t_crit")).alias("_t"))
    v = fit.vcov.T @ fit.vcov if v_mode == "squared" else fit.vcov
    out = df.join(per, fit.entity, "left")
    return out.withColumns({"_eta": add_coef_terms(fit.slopes) + F.col("_fe"), "_q": quadratic_form(fit.xs, v)})


def _bounds(fit: LinearFit, type: str, sigma: str, smearing: str) -> dict[str, Column]:
    """Prediction and bounds from the columns of ``_with_statistics``."""
    _choices(
        type=(type, ("prediction", "forecast")),
        sigma=(sigma, ("default", "specific")),
        smearing=(smearing, ("default", "specific")),
    )
    r = F.col("resid")
    al = F.col("_al") if smearing == "specific" else fit.scored().agg(F.avg(F.exp(r))).scalar()
    var = F.col("_q")
    if type == "forecast":
        var = var + (F.col("_s2") if sigma == "specific" else fit.scored().agg(F.avg(r * r)).scalar())
    log_pred = F.col("_eta") + F.ln(al)
    half = F.col("_t") * F.sqrt(var)
    return {"prediction": F.exp(log_pred), "lower": F.exp(log_pred - half), "upper": F.exp(log_pred + half)}


_WORK = ("_fe", "_s2", "_al", "_t", "_eta", "_q")


def interval(
    df: DataFrame,
    fit: LinearFit,
    type: str = "prediction",
    sigma: str = "default",
    smearing: str = "default",
    alpha: float = 0.05,
    v_mode: str = "vcov",
) -> DataFrame:
    """Smeared prediction with lower and upper bound for every row of ``df``.

    The squared standard error is x'Vx for ``prediction`` and sigma^2 + x'Vx for
    ``forecast``. ``sigma`` and ``smearing`` use all residuals ("default") or the
    entity's own ("specific"). The critical value has N_i - k - 1 degrees of
    freedom; an entity without any gets null bounds. ``v_mode="squared"`` takes
    V'V in place of V, for parity with earlier results.
    """
    cols = _bounds(fit, type, sigma, smearing)
    return _with_statistics(df, fit, alpha, v_mode).withColumns(cols).drop(*_WORK)


def scenario_sweep(
    template: DataFrame, fit: LinearFit, col: str, lo: float, hi: float, n: int, derive=None, alpha: float = 0.05
) -> DataFrame:
    """Prediction and both interval types while ``col`` runs over n values.

    ``derive`` adds the columns that follow from ``col`` (its square, a flag).
    Both intervals come from one pass over the grid. The prediction and its
    interval use the overall smearing factor, the forecast the entity's own.
    """
    grid = scenario_grid(template, col, lo, hi, n)
    if derive is not None:
        grid = derive(grid)
    pred = _bounds(fit, "prediction", "specific", "default")
    fore = _bounds(fit, "forecast", "specific", "specific")
    return _with_statistics(grid, fit, alpha, "vcov").select(
        fit.entity,
        col,
        *[c.alias(name) for name, c in pred.items()],
        *[fore[b].alias(f"{b}_forecast") for b in ("lower", "upper")],
    )


# Layer limits of the rescaled effect; the last one lies above
# the maximum 4, so that the top entity falls in layer 4.
LAYER_BREAKS = [0.0, 1.0, 2.0, 3.0, 4.1]


def rescale_effects(fixef: DataFrame, top: float = 4.0, digits: int = 3) -> DataFrame:
    """Effects rescaled to [0, top], with layer 1-4 and rounded (half-even) columns."""
    lo, hi = fixef.agg(F.min("fe")).scalar(), fixef.agg(F.max("fe")).scalar()
    out = fixef.withColumn("scaled_fe", F.try_divide((F.col("fe") - lo) * top, hi - lo))
    return out.withColumns(
        {
            "layer": cut_bins(F.col("scaled_fe"), LAYER_BREAKS),
            "round_fe": F.bround("fe", digits),
            "round_scaled_fe": F.bround("scaled_fe", digits),
        }
    )


def rank_effects(fixef: DataFrame, entity: str, k: int = 5, top: bool = True) -> DataFrame:
    """The k largest (or smallest) effects; ties by entity."""
    c = F.col("fe")
    return fixef.orderBy(c.desc_nulls_last() if top else c.asc_nulls_last(), entity).limit(k).select(entity, "fe")


