"""Count and binary models."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import add_coef_terms, log_factorial, one_hot
from ..operators.describe import histogram
from ..operators.ranking import exact_quantiles
from ..operators.slices import join_spread
from ..session import Scratch, cut_lineage
from .gram import MAX_SQL_COLUMNS, inverse_spd, moments, solve_spd
from .linear import _keep, _shifted, _shifts, estimation_sample


MAX_STEPS = 50


def glm(df: DataFrame, y: str, xs: list[str], family: str) -> DataFrame:
    """Generalised linear model by iteratively reweighted least squares.

    Returns term, estimate, std_error, statistic, p_value.
    """
    sample = estimation_sample(df, y, xs, [])
    rows = VectorAssembler(inputCols=xs, outputCol="features").transform(sample).select(y, "features")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    model = GeneralizedLinearRegression(
        family=family, labelCol=y, featuresCol="features", maxIter=MAX_STEPS, tol=1e-12
    ).fit(rows)
    s = model.summary
    if s.numIterations >= MAX_STEPS:
        raise RuntimeError(f"no convergence within {MAX_STEPS} steps")
    # the summary lists the slopes first and the intercept last
    out = list(
        zip(
            [*xs, "(Intercept)"],
            [*[float(b) for b in model.coefficients], float(model.intercept)],
            [float(v) for v in s.coefficientStandardErrors],
            [float(v) for v in s.tValues],
            [float(v) for v in s.pValues],
        )
    )
    rows.unpersist()
    return df.sparkSession.createDataFrame(
        out, "term string, estimate double, std_error double, statistic double, p_value double"
    )


def glm_poisson(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    return glm(df, y, xs, "poisson")


def glm_binomial(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Logit of a boolean or 0/1 column, e.g. a missingness indicator."""
    return glm(df.withColumn(y, F.col(y).cast("int")), y, xs, "binomial")


def glm_poisson_by_entity(df: DataFrame, y: str, x: str, entity: str, tol: float = 1e-10) -> DataFrame:
    """Poisson y ~ 1 + x for every entity, all entities in step.

    Rows with the same entity and x are merged to one with their number and total. An
    iteration joins the coefficients of the entities that still move to these,
    makes five sums per entity and updates both coefficients in closed form, until
    no entity moves by ``tol``; an entity that has settled is not read again by a
    join. Returns (entity, n_i, b0, b1, step, converged): ``step`` is the size of
    the last update; the coefficients are null, and ``converged`` false, where x or
    the total of y has no variation to fit. Entities that still move after
    ``MAX_STEPS`` are not ``converged`` either.
    """
    scratch = Scratch()
    X, Y, N = F.col("_x"), F.col("_sy"), F.col("_n")
    sample = estimation_sample(df, y, [x], [entity])
    cells = scratch.keep(sample.groupBy(entity, F.col(x).alias("_x")).agg(F.sum(y).alias("_sy"), F.count(F.lit(1)).alias("_n")))
    start = cells.groupBy(entity).agg(F.sum(N).alias("n_i"), F.sum(Y).alias("_y"), (F.sum(X * N) / F.sum(N)).alias("_mx"))
    level = F.ln(F.nullif(F.col("_y") / F.col("n_i"), F.lit(0.0)))
    none = F.lit(None).cast("double")
    active = scratch.keep(start.select(entity, "n_i", level.alias("b0"), F.lit(0.0).alias("b1"), "_mx", none.alias("step")))
    settled = []
    for _ in range(MAX_STEPS):
        rows = join_spread(cells, active, entity)
        xc = X - F.col("_mx")
        mu = N * F.exp(F.col("b0") + F.col("b1") * xc)
        r = Y - mu
        sums = rows.groupBy(entity).agg(
            *[F.max(c).alias(c) for c in ("n_i", "b0", "b1", "_mx")],
            F.sum(r).alias("g0"), F.sum(r * xc).alias("g1"),
            F.sum(mu).alias("h00"), F.sum(mu * xc).alias("h01"), F.sum(mu * xc * xc).alias("h11"),
        )
        g0, g1, h00, h01, h11 = (F.col(c) for c in ("g0", "g1", "h00", "h01", "h11"))
        det = h00 * h11 - h01 * h01
        ok = det > 1e-20 * h00 * h00 * F.col("_mx") * F.col("_mx")  # x varies beyond rounding
        d0 = F.when(ok, F.try_divide(h11 * g0 - h01 * g1, det))
        d1 = F.when(ok, F.try_divide(h00 * g1 - h01 * g0, det))
        cur = scratch.keep(
            sums.select(
                entity, "n_i", (F.col("b0") + d0).alias("b0"), (F.col("b1") + d1).alias("b1"), "_mx",
                F.greatest(F.abs(d0), F.abs(d1)).alias("step"),
            )
        )
        # an exactly solvable entity may swing in the last digit of a large coefficient
        moves = F.coalesce(F.col("step") > tol * (1 + F.abs("b0") + F.abs("b1")), F.lit(False))
        settled.append(cur.filter(~moves))
        active = cur.filter(moves)
        if not active.limit(1).count():
            break
    else:
        settled.append(active)
    cur = cut_lineage(reduce(DataFrame.union, settled))
    scratch.drop()
    done = F.coalesce(F.col("step") <= 1e-8 * (1 + F.abs("b0") + F.abs("b1")), F.lit(False))
    b0 = F.col("b0") - F.col("b1") * F.col("_mx")
    return cur.select(entity, "n_i", b0.alias("b0"), "b1", "step", done.alias("converged"))


def coefficient_summary(by_entity: DataFrame, pooled: DataFrame, x: str) -> DataFrame:
    """(coef, stat, value): the distribution of the converged entities' coefficients beside those of the pooled fit."""
    long = by_entity.filter("converged").unpivot([], ["b0", "b1"], "coef", "v")
    quartiles = exact_quantiles(long, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["coef"])
    ends = long.groupBy("coef").agg(F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))
    names = ["min", "q1", "median", "mean", "q3", "max"]
    out = ends.join(quartiles, "coef").unpivot(["coef"], names, "stat", "value")
    of = F.when(F.col("term") == "(Intercept)", "b0").when(F.col("term") == x, "b1")
    every = pooled.select(of.alias("coef"), F.lit("all").alias("stat"), F.col("estimate").alias("value"))
    return out.unionByName(every)


def coefficient_histogram(by_entity: DataFrame, coef: str, lo: float, hi: float, width: float) -> DataFrame:
    """Counts of the converged entities' coefficients per bin, values beyond the breaks in the outer bins."""
    return histogram(by_entity.filter("converged"), coef, lo, hi, width)


@dataclass
class PoissonFit:
    """Poisson regression with entity (and time category) effects."""

    y: str
    xs: list[str]  # covariates, then the dummies of the time category
    beta: np.ndarray
    hessian: np.ndarray
    n: int
    n_entities: int
    iterations: int
    last_step: float
    sample: DataFrame
    entity: str
    fixef: DataFrame  # entity, n_i, total, fe and xbar_<i>
    covariates: list[str] = field(default_factory=list)
    month_effects: dict = field(default_factory=dict)

    @property
    def terms(self) -> list[str]:
        return self.xs

    @property
    def vcov(self) -> np.ndarray:
        return inverse_spd(self.hessian)

    @property
    def slopes(self) -> dict[str, float]:
        return {t: float(b) for t, b in zip(self.xs, self.beta)}

    def scored(self) -> DataFrame:
        """Sample rows of entities with a positive total: fitted mean and residual."""
        return self._with_fitted(["fe"])

    def _with_fitted(self, effects: list[str]) -> DataFrame:
        out = join_spread(self.sample, self.fixef.select(self.entity, *effects), self.entity)
        lam = F.exp(add_coef_terms(self.slopes) + F.col("fe"))
        return out.withColumn("fitted", lam).withColumn("resid", F.col(self.y) - F.col("fitted"))

    def scores(self) -> tuple[DataFrame, list[str]]:
        """Rows with the score contributions (x - xbar_i)(y - fitted)."""
        xb = [f"xbar_{i}" for i in range(len(self.xs))]
        rows = self._with_fitted(["fe", *xb])
        names = [f"_sc{i}" for i in range(len(self.xs))]
        cols = {n: (F.col(x) - F.col(b)) * F.col("resid") for n, x, b in zip(names, self.xs, xb)}
        return rows.withColumns(cols), names

    def release(self) -> None:
        self.sample.unpersist()


def _entity_sums(sample: DataFrame, y: str, entity: str, xc: list[Column], beta: np.ndarray, squares: bool) -> DataFrame:
    """Y, S = sum e, sum x e (and sum x x' e) per entity, with e = exp(x'b)."""
    # The exponential is a column, computed once per row. The shifted covariates stay
    # expressions: as aliases beside it they make Spark's constraint inference
    # try every subset of replacements (2^k).
    rows = sample.withColumn("_e", _exp_index(xc, beta))
    e = F.col("_e")
    aggs = [F.sum(y).alias("Y"), F.sum(e).alias("S"), F.count(F.lit(1)).alias("n_i")]
    aggs += [F.sum(e * c).alias(f"sx{i}") for i, c in enumerate(xc)]
    if squares:
        k = len(xc)
        aggs += [F.sum(e * xc[i] * xc[j]).alias(f"sxx{i}_{j}") for i in range(k) for j in range(i, k)]
    return rows.groupBy(entity).agg(*aggs)


def _exp_index(xc: list[Column], beta: np.ndarray) -> Column:
    eta = F.lit(0.0)
    for b, c in zip(beta, xc):
        eta = eta + F.lit(float(b)) * c
    return F.exp(eta)


def poisson_fe(
    df: DataFrame,
    y: str,
    xs: list[str],
    entity: str,
    time_cat: str | None = None,
    levels: list | None = None,
    keys: list[str] = (),
    iterations: int = 25,
    tol: float = 1e-10,
) -> PoissonFit:
    """Poisson regression with entity effects and, optionally, effects of a small category.

    The entity effects are concentrated out of Newton's method, so an iteration
    is one partial aggregation per entity and one k x k solve, whatever the
    number of entities. The category (months, say) enters as dummies; its first
    level has effect zero. Entities with a zero total have no finite effect: they
    add nothing to the estimate and are absent from ``fixef``.
    """
    names = list(xs)
    if time_cat is not None:
        df, dummies = one_hot(df, time_cat, levels)
        names += dummies
    extra = [time_cat] if time_cat is not None else []
    sample = _keep(estimation_sample(df, y, names, [entity, *keys, *extra]))
    means = _shifts(sample, names)
    xc = _shifted(names, means)
    k = len(names)
    xy = np.array(sample.agg(*[F.sum(c * F.col(y)).alias(f"c{i}") for i, c in enumerate(xc)]).first(), float)
    beta, step, done = np.zeros(k), float("inf"), 0
    while True:
        grad_model, hess = _newton_sums(sample, y, entity, xc, beta)
        if done == iterations or step < tol:
            break
        d = solve_spd(hess, xy - grad_model)
        beta, step, done = beta + d, float(np.max(np.abs(d))), done + 1
    if step >= tol:
        raise RuntimeError(f"no convergence within {iterations} steps: the last one was {step:.3g}")
    ent = _entity_sums(sample, y, entity, xc, beta, False).filter("Y > 0")
    shift = float(sum(b * means[x] for b, x in zip(beta, names)))
    fixef = ent.select(
        entity, "n_i", F.col("Y").alias("total"), (F.ln(F.col("Y") / F.col("S")) - F.lit(shift)).alias("fe"),
        *[(F.col(f"sx{i}") / F.col("S") + F.lit(means[x])).alias(f"xbar_{i}") for i, x in enumerate(names)],
    )
    size = fixef.agg(F.sum("n_i"), F.count(F.lit(1))).first()
    months = {}
    if time_cat is not None:
        months = {levels[0]: 0.0} | {lv: float(b) for lv, b in zip(levels[1:], beta[len(xs):])}
    return PoissonFit(
        y, names, beta, hess, int(size[0]), int(size[1]), done, step, sample, entity, fixef, list(xs), months
    )


def _newton_sums(sample: DataFrame, y: str, entity: str, xc: list[Column], beta: np.ndarray):
    """sum lambda x and the Hessian sum lambda (x - xbar_i)(x - xbar_i)'."""
    k = len(xc)
    r = F.col("Y") / F.col("S")
    if k <= MAX_SQL_COLUMNS - 1:
        ent = _entity_sums(sample, y, entity, xc, beta, True)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = ent.agg(
            *[F.sum(r * F.col(f"sx{i}")) for i in range(k)],
            *[F.sum(r * (F.col(f"sxx{i}_{j}") - F.col(f"sx{i}") * F.col(f"sx{j}") / F.col("S"))) for i, j in pairs],
        ).first()
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[k:]):
            h[i, j] = h[j, i] = v
        return np.array(row[:k], float), h
    # many columns: the products come from one pass over the rows with weight lambda
    ent = _entity_sums(sample, y, entity, xc, beta, False).persist(StorageLevel.MEMORY_AND_DISK)
    between = moments(ent, [F.col(f"sx{i}") / F.col("S") for i in range(k)], F.col("Y"))
    rows = sample.join(ent.select(entity, r.alias("_r")), entity)
    total = moments(rows, xc, F.col("_r") * _exp_index(xc, beta))
    ent.unpersist()
    return total.s, total.c - between.c


def poisson_fit_statistics(fit: PoissonFit) -> DataFrame:
    """Log likelihood, BIC, adjusted pseudo R2 and squared correlation."""
    y, lam = F.col(fit.y), F.col("fitted")
    s = fit.scored()
    row = s.agg(
        F.sum(y * F.ln(lam) - lam - log_factorial(y)).alias("ll"),
        F.sum(log_factorial(y)).alias("lf"),
        F.sum(y).alias("sy"),
        F.try_divide(F.pow(F.covar_pop(y, lam), 2), F.var_pop(y) * F.var_pop(lam)).alias("sq_cor"),
    )
    n, params = float(fit.n), float(len(fit.xs) + fit.n_entities)
    ll0 = F.col("sy") * F.ln(F.col("sy") / n) - F.col("sy") - F.col("lf")
    return row.select(
        F.lit(fit.n).cast("long").alias("n"),
        F.col("ll").alias("log_lik"),
        (-2 * F.col("ll") + params * F.ln(F.lit(n))).alias("bic"),
        (1 - (F.col("ll") - (params - 1)) / ll0).alias("adj_pseudo_r2"),
        "sq_cor",
    )
