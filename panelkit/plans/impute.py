"""Recursive imputation of a faulty period in weekly waves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import add_coef_terms, hash_uniform, poisson_draw


def mark_period(df: DataFrame, t: str, first: int, last: int, name: str = "in_period") -> DataFrame:
    return df.withColumn(name, F.col(t).between(first, last))


def exclude_period(df: DataFrame, t: str, first, last) -> DataFrame:
    return df.filter(~F.col(t).between(first, last))


@dataclass
class CountModel:
    """What the imputation needs from a Poisson fit.

    ``day_terms`` are coefficients of columns of the day table, ``lag_coef`` the
    one of the lagged count, ``fixef`` holds (entity, fe).
    """

    day_terms: dict[str, float]
    lag_coef: float
    fixef: DataFrame


def impute_period(
    panel: DataFrame,
    days: DataFrame,
    model: CountModel,
    entity: str,
    t: str,
    y: str,
    first: int,
    last: int,
    period: int = 7,
    effect: str = "effect",
    july_effect: str | None = None,
    draw: str = "poisson",
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Impute y for the rows with first <= t <= last.

    ``days`` has one row per t with the day-level covariates and ``effect``, the
    effect of the day's month (inside the period: the interpolated day effect).
    A day's mean depends on the count one week ago, so days with the same
    weekday offset form a chain and all else is independent. The panel is turned
    into one row per (entity, offset), holding the counts of the three weeks
    before and which days of the period exist. A fold over the weeks carries the
    last three counts, so there is one shuffle, no loop over days or entities, and
    a plan of the same size for any number of weeks.

    If the count a week ago is absent or null, it is drawn from that day's own
    mean given the count two weeks ago, which in turn may be drawn given the one
    three weeks ago. If that is null as well the row is rejected.
    ``july_effect`` names a second effect column that is added to the mean of
    those drawn past days (counting it twice reproduces a known quirk).

    Returns (entity, t, lambda, y_imputed) and the rejected (entity, t).
    """
    if draw not in ("poisson", "expected"):
        raise ValueError("draw must be 'poisson' or 'expected'")
    n_waves = -(-(last - first + 1) // period)
    start = first - 3 * period  # step 0, 1, 2 are the weeks before, then the waves
    n_steps = n_waves + 3
    offset = F.pmod(F.col(t) - F.lit(start), F.lit(period)).cast("int")
    step = F.floor((F.col(t) - F.lit(start)) / F.lit(period)).cast("int")

    near = panel.filter(F.col(t).between(start, last))
    at = lambda s, c: F.max(F.when(step == s, c))  # noqa: E731  (entity, t) is unique
    chains = near.groupBy(entity, offset.alias("_o")).agg(
        *[at(s, F.col(y).cast("double")).alias(f"_y{s}") for s in range(3)],
        F.collect_set(F.when(step >= 3, step)).alias("_has"),
    )
    base = add_coef_terms(model.day_terms) + F.col(effect)
    extra = F.col(july_effect) if july_effect else F.lit(0.0)
    # one row per weekday offset: the day part of the linear predictor of each week, for its own and for drawn past days
    etas = (
        days.filter(F.col(t).between(start, last))
        .groupBy(offset.alias("_o"))
        .agg(F.map_from_entries(F.collect_list(F.struct(step, F.struct(base.alias("own"), (base + extra).alias("past"))))).alias("_m"))
    )
    etas = etas.select("_o", F.transform(F.sequence(F.lit(0), F.lit(n_steps - 1)), lambda s: F.try_element_at("_m", s)).alias("_eta"))
    out = chains.join(F.broadcast(etas), "_o").join(model.fixef.select(entity, "fe"), entity, "left")

    def mean(eta: Column, lag: Column) -> Column:
        return F.exp(eta + F.col("fe") + F.lit(float(model.lag_coef)) * lag)

    def drawn(lam: Column, s: Column, kind: str) -> Column:
        if draw == "expected":
            return lam
        day = F.lit(start) + s * period + F.col("_o")
        return poisson_draw(lam, hash_uniform(F.col(entity), day, F.lit(seed), F.lit(kind))).cast("double")

    def let(value: Column, body) -> Column:
        """``body`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), body), 0)

    def past(s: Column) -> Column:
        e = F.get("_eta", s)
        return F.when(s < 3, e["past"]).otherwise(e["own"])

    def week(c: Column, s: Column) -> Column:
        # c1, c2, c3: counts one, two and three weeks back; a draw is null unless needed, as that of a null mean is null
        back2 = F.coalesce(c["c2"], drawn(F.when(c["c1"].isNull() & c["c2"].isNull(), mean(past(s - 2), c["c3"])), s, "back2"))
        has = F.array_contains("_has", s)

        def today(lam: Column) -> Column:
            cell = lambda new: F.struct(s.alias("s"), has.alias("has"), lam.alias("lambda"), new.alias("y"))
            return let(
                drawn(lam, s, "day"),
                lambda new: F.struct(new.alias("c1"), c["c1"].alias("c2"), c["c2"].alias("c3"), F.concat(c["out"], F.array(cell(new))).alias("out")),
            )

        def lagged(lag: Column) -> Column:
            return let(F.when(has, mean(F.get("_eta", s)["own"], lag)), today)

        return let(back2, lambda two: let(F.coalesce(c["c1"], drawn(F.when(c["c1"].isNull(), mean(past(s - 1), two)), s, "back1")), lagged))

    none = F.array().cast("array<struct<s:int,has:boolean,lambda:double,y:double>>")
    begin = F.struct(F.col("_y2").alias("c1"), F.col("_y1").alias("c2"), F.col("_y0").alias("c3"), none.alias("out"))
    weeks = F.aggregate(F.sequence(F.lit(3), F.lit(n_steps - 1)), begin, week, lambda c: c["out"])
    out = out.select(entity, "_o", F.explode(weeks).alias("_w"))
    cells = F.struct(
        (F.lit(start) + F.col("_w.s") * period + F.col("_o")).cast("int").alias(t),
        F.col("_w.has").alias("has"), F.col("_w.lambda").alias("lambda"), F.col("_w.y").alias("y_imputed"),
    )
    rows = out.select(entity, cells.alias("_c")).select(entity, "_c.*").filter("has").drop("has")
    return rows.filter(F.col("lambda").isNotNull()), rows.filter(F.col("lambda").isNull()).select(entity, t)


def apply_imputation(
    panel: DataFrame, imputed: DataFrame, entity: str, t: str, y: str, rejected: DataFrame | None = None
) -> DataFrame:
    """Replace y by the imputed count where there is one; ``is_imputed`` marks the rows.

    The count of a rejected row becomes null, and ``is_rejected`` marks it: it is
    known to be faulty. Lags have to be built again from the result, which also renews those of the
    first days after the period.
    """
    out = panel.join(imputed.select(entity, t, "y_imputed"), [entity, t], "left")
    bad = F.lit(False)
    if rejected is not None:
        out = out.join(rejected.select(entity, t, F.lit(True).alias("_bad")), [entity, t], "left")
        bad = F.coalesce("_bad", F.lit(False))
    return out.withColumns(
        {
            y: F.when(~bad, F.coalesce(F.col("y_imputed"), F.col(y).cast("double"))),
            "is_imputed": F.col("y_imputed").isNotNull(),
            "is_rejected": bad,
        }
    ).drop("y_imputed", "_bad")


def compare_periods(raw: DataFrame, imputed: DataFrame, entity: str, t: str, y: str) -> DataFrame:
    """Mean of the raw and the imputed count, imputed rows and others, per entity; rejected rows are left out."""
    r = raw.select(entity, t, F.col(y).cast("double").alias("y_raw"))
    i = imputed.filter(~F.col("is_rejected")).select(entity, t, F.col(y).alias("y_new"), "is_imputed")
    return (
        i.join(r, [entity, t])
        .groupBy(entity, "is_imputed")
        .agg(F.avg("y_raw").alias("mean_raw"), F.avg("y_new").alias("mean_imputed"), F.count(F.lit(1)).alias("n"))
    )
