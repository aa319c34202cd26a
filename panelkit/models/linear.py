"""Linear panel regressions from distributed sufficient statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import add_coef_terms
from ..operators.slices import join_spread
from .gram import MAX_SQL_COLUMNS, cross_sums, ill_conditioned, independent, inverse_spd, moments, solve_spd, triangle


def estimation_sample(df: DataFrame, y: str, xs: list[str], keys: list[str], positive: list[str] = ()) -> DataFrame:
    """Model columns of the rows with no null and no non-positive value to be logged."""
    out = df.select(*dict.fromkeys([*keys, y, *xs, *positive])).na.drop("any", subset=[*dict.fromkeys([*keys, y, *xs])])
    for c in positive:
        out = out.filter(F.col(c) > 0)
    return out.withColumns({c: F.col(c).cast("double") for c in [y, *xs]})


@dataclass
class LinearFit:
    """Coefficients on the driver, rows on the cluster."""

    kind: str  # pooled | within | fgls
    y: str
    xs: list[str]
    terms: list[str]
    beta: np.ndarray
    vcov: np.ndarray
    sigma2: float
    n: int
    df_resid: int
    rss: float
    tss: float
    bread: np.ndarray  # inverse of X'X of the slopes (demeaned for within)
    sample: DataFrame
    entity: str | None = None
    n_entities: int | None = None
    fixef: DataFrame | None = None  # entity, n_i, fe
    means: dict[str, float] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)  # columns that depend on those before them

    @property
    def slopes(self) -> dict[str, float]:
        return {t: float(b) for t, b in zip(self.terms, self.beta) if t != "(Intercept)"}

    @property
    def intercept(self) -> float:
        return float(self.beta[0]) if self.terms[0] == "(Intercept)" else 0.0

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss

    @property
    def adj_r2(self) -> float:
        lost = 1 if self.kind == "pooled" else 0
        return 1 - (self.rss / self.df_resid) / (self.tss / (self.n - lost))

    def scored(self) -> DataFrame:
        """Sample rows with fitted value (level of y) and residual."""
        out = self.sample
        fit = add_coef_terms(self.slopes) + F.lit(self.intercept)
        if self.fixef is not None:
            out = join_spread(out, self.fixef.select(self.entity, "fe"), self.entity)
            fit = fit + F.col("fe")
        return out.withColumn("fitted", fit).withColumn("resid", F.col(self.y) - F.col("fitted"))

    def release(self) -> None:
        self.sample.unpersist()


def _keep(sample: DataFrame) -> DataFrame:
    """The estimation sample is read by every pass of a fit; spill rather than fail."""
    return sample.persist(StorageLevel.MEMORY_AND_DISK)


def _shifts(sample: DataFrame, cols: list[str]) -> dict[str, float]:
    """Overall means. Working around them keeps large sums from cancelling."""
    r = sample.agg(*[F.avg(c).alias(c) for c in cols]).first()
    if r[0] is None:
        raise ValueError("the estimation sample is empty")
    return {c: r[c] for c in cols}


def _shifted(cols: list[str], means: dict[str, float]) -> list[Column]:
    return [F.col(c) - F.lit(means[c]) for c in cols]


def _by_qr(rows: DataFrame, cols: list[Column], whole: list[Column], skip: int = 0) -> tuple[list[int], np.ndarray, float, float, np.ndarray, np.ndarray]:
    """Kept columns, slopes, RSS, TSS, (X'X)^-1 and the first ``skip`` rows of R, from R of [skip columns, X, y].

    ``whole`` are the covariates before entity effects are taken out.
    """
    k = len(whole)
    lengths = np.sqrt(np.array(rows.agg(*[F.sum(c * c) for c in whole]).first(), float))
    r = triangle(rows, cols)
    lead, rest = r[:skip], r[skip:, skip:]
    keep, small = independent(rest, k, lengths)
    m = len(keep)
    if not m:
        raise np.linalg.LinAlgError("no column varies")
    inverse = np.linalg.inv(small[:m, :m])
    beta = inverse @ small[:m, m]
    rss = float(small[m, m] ** 2)
    return keep, beta, rss, rss + float(small[:m, m] @ small[:m, m]), inverse @ inverse.T, lead


def ols_pooled(df: DataFrame, y: str, xs: list[str], keys: list[str] = (), positive: list[str] = (), qr: bool | None = None) -> LinearFit:
    """Ordinary least squares with an intercept.

    Many or nearly collinear columns go by QR of the rows (``qr`` forces it), the
    others by cross products. Columns that depend on earlier ones are left out and named in ``dropped``.
    """
    sample = _keep(estimation_sample(df, y, xs, list(keys), positive))
    means = _shifts(sample, [*xs, y])
    by_qr = len(xs) + 1 > MAX_SQL_COLUMNS if qr is None else qr
    m = None if by_qr else moments(sample, _shifted([*xs, y], means))
    by_qr = by_qr or (qr is None and ill_conditioned(m.centred()[: len(xs), : len(xs)]))
    names = list(xs)
    if by_qr:
        keep, slopes, rss, tss, bread, lead = _by_qr(sample, [F.lit(1.0), *_shifted([*xs, y], means)], _shifted(xs, means), 1)
        names = [xs[i] for i in keep]
        n = int(round(lead[0, 0] ** 2))
        left = lead[0, 1:] / lead[0, 0]  # what the means miss
        mu, my = np.array([means[xs[i]] + left[i] for i in keep]), means[y] + left[-1]
    else:
        c = m.centred()
        k, n = len(xs), int(round(m.n))
        slopes = solve_spd(c[:k, :k], c[:k, k])
        tss = float(c[k, k])
        rss = float(tss - slopes @ c[:k, k])
        bread = inverse_spd(c[:k, :k])
        mu, my = np.array([means[x] for x in xs]) + m.s[:k] / m.n, means[y] + m.s[k] / m.n
    k = len(names)
    df_resid = n - k - 1
    sigma2 = rss / df_resid
    b0 = my - mu @ slopes
    v = np.zeros((k + 1, k + 1))
    v[1:, 1:] = bread
    v[0, 1:] = v[1:, 0] = -bread @ mu
    v[0, 0] = 1 / n + mu @ bread @ mu
    return LinearFit(
        "pooled", y, names, ["(Intercept)", *names], np.append(b0, slopes), sigma2 * v, sigma2, n, df_resid,
        rss, tss, bread, sample, means=means, dropped=[x for x in xs if x not in names],
    )


def within(
    df: DataFrame, y: str, xs: list[str], entity: str, keys: list[str] = (), positive: list[str] = (), qr: bool | None = None
) -> LinearFit:
    """Entity fixed effects (one-way within estimator).

    The demeaned cross products are the total ones minus the between part
    sum_i n_i xbar_i xbar_i', so no demeaned row is ever formed or shuffled: one
    pass adds up the products, one partial aggregation makes entity sums.

    Many or nearly collinear columns go by QR of the demeaned rows instead (``qr``
    forces it): products would square the condition. Columns that depend on
    earlier ones are left out and named in ``dropped``.
    """
    sample = _keep(estimation_sample(df, y, xs, [entity, *keys], positive))
    cols = [*xs, y]
    means = _shifts(sample, cols)
    sums = [F.sum(c).alias(f"_s{i}") for i, c in enumerate(_shifted(cols, means))]
    ent = sample.groupBy(entity).agg(F.count(F.lit(1)).alias("n_i"), *sums)
    k, names = len(xs), list(xs)
    by_qr = k + 1 > MAX_SQL_COLUMNS if qr is None else qr
    if not by_qr:
        total = moments(sample, _shifted(cols, means))
        between = moments(ent, [F.col(f"_s{i}") / F.sqrt("n_i") for i in range(len(cols))])
        n, g = int(round(total.n)), int(round(between.n))
        c = total.c - between.c
        by_qr = qr is None and ill_conditioned(c[:k, :k])
    if by_qr:
        rows = join_spread(sample, ent, entity)
        dm = [s - F.col(f"_s{i}") / F.col("n_i") for i, s in enumerate(_shifted(cols, means))]
        keep, beta, rss, tss, bread, _ = _by_qr(rows, dm, _shifted(xs, means))
        names = [xs[i] for i in keep]
        n, g = (int(v) for v in ent.agg(F.sum("n_i"), F.count(F.lit(1))).first())
    else:
        beta = solve_spd(c[:k, :k], c[:k, k])
        tss = float(c[k, k])
        rss = float(tss - beta @ c[:k, k])
        bread = inverse_spd(c[:k, :k])
    df_resid = n - g - len(names)
    sigma2 = rss / df_resid
    fe = F.col(f"_s{k}") / F.col("n_i") + F.lit(means[y])
    for b, x in zip(beta, names):
        fe = fe - F.lit(float(b)) * (F.col(f"_s{xs.index(x)}") / F.col("n_i") + F.lit(means[x]))
    fixef = ent.select(entity, "n_i", fe.alias("fe"))
    return LinearFit(
        "within", y, names, names, beta, sigma2 * bread, sigma2, n, df_resid, rss, tss, bread, sample,
        entity, g, fixef, means, [x for x in xs if x not in names],
    )


def demean(df: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    """Columns minus their entity mean, through an aggregate and a join on the entity.

    A window would hold the whole entity in one task; the join can be split for
    a hot entity by the adaptive skew handling.
    """
    means = df.groupBy(entity).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = df.join(means, entity)
    return out.select(*df.columns, *[(F.col(c) - F.col(f"_m_{c}")).alias(f"{c}_dm") for c in cols])


def ols_by_entity(df: DataFrame, y: str, xs: list[str], entity: str) -> DataFrame:
    """Separate regression per entity: coefficients, RSS, df.

    The shuffle carries cross products only; each batch of entities is solved at
    once. An entity with too few rows or no variation gets null coefficients.
    Returns (entity, n_i, b0, b_<x>..., rss, df_resid).
    """
    k = len(xs)
    sample = estimation_sample(df, y, xs, [entity])
    means = _shifts(sample, [*xs, y])
    grams = sample.groupBy(entity).agg(
        *[c.alias(n) for n, c in cross_sums(_shifted([*xs, y], means)).items()]
    )
    names = ["b0", *[f"b_{x}" for x in xs]]
    mu = np.array([means[x] for x in xs])
    upper = np.triu_indices(k + 2)

    def fit(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            m = np.zeros((len(b), k + 2, k + 2))
            m[:, upper[0], upper[1]] = b.iloc[:, 1:].to_numpy(dtype=float)
            m = m + np.transpose(np.triu(m, 1), (0, 2, 1))
            n = m[:, 0, 0]
            s = m[:, 0, 1:]
            c = m[:, 1:, 1:] - s[:, :, None] * s[:, None, :] / n[:, None, None]
            a, r = c[:, :k, :k], c[:, :k, k]
            var, raw = np.einsum("ijj->ij", a), np.einsum("ijj->ij", m)[:, 1 : k + 1]
            ok = (n > k + 1) & np.all(var > 1e-12 * raw, axis=1)
            d = np.sqrt(np.where(ok[:, None], var, 1.0))
            scaled = np.where(ok[:, None, None], a / (d[:, :, None] * d[:, None, :]), np.eye(k))
            ok &= np.linalg.cond(scaled) < 1e12
            scaled = np.where(ok[:, None, None], scaled, np.eye(k))
            beta = np.linalg.solve(scaled, (r / d)[:, :, None])[:, :, 0] / d
            rss = c[:, k, k] - np.einsum("ij,ij->i", beta, r)
            b0 = means[y] + s[:, k] / n - np.einsum("ij,ij->i", beta, mu + s[:, :k] / n[:, None])
            out = pd.DataFrame(np.column_stack([b0, beta, rss]), columns=[*names, "rss"])
            out[~ok] = np.nan
            out.insert(0, "n_i", n.astype("int64"))
            out.insert(0, entity, b[entity].to_numpy())
            out["df_resid"] = n.astype("int64") - k - 1
            yield out.astype(object).where(out.notna(), None)

    ent_type = sample.schema[entity].dataType.simpleString()
    schema = f"`{entity}` {ent_type}, n_i bigint, " + ", ".join(f"`{n}` double" for n in names)
    return grams.mapInPandas(fit, schema + ", rss double, df_resid bigint")


def coef_table(fit, vcov: np.ndarray | None = None) -> DataFrame:
    """term, estimate, std_error, statistic, p_value."""
    v = fit.vcov if vcov is None else vcov
    terms, beta = (fit.terms, fit.beta) if len(v) == len(fit.beta) else (fit.xs, fit.beta[-len(v):])
    se = np.sqrt(np.diag(v))
    rows = []
    for t, b, s in zip(terms, beta, se):
        z = float(b / s)
        df = getattr(fit, "df_resid", None)
        p = dist.t_two_sided(z, df) if isinstance(fit, LinearFit) else dist.normal_two_sided(z)
        rows.append((t, float(b), float(s), z, float(p)))
    spark = fit.sample.sparkSession
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, p_value double")


def fit_statistics(fit: LinearFit) -> DataFrame:
    """n, R2, adjusted R2 and the squared correlation of y and the fitted value."""
    s = fit.scored()
    cor = s.agg(F.try_divide(F.pow(F.covar_pop(fit.y, "fitted"), 2), F.var_pop(fit.y) * F.var_pop("fitted")).alias("sq_cor"))
    return cor.select(
        F.lit(fit.n).cast("long").alias("n"),
        F.lit(fit.df_resid).cast("long").alias("df_resid"),
        F.lit(float(fit.r2)).alias("r2"),
        F.lit(float(fit.adj_r2)).alias("adj_r2"),
        "sq_cor",
    )


def compare_fixef(a: DataFrame, b: DataFrame, entity: str, names=("fe_a", "fe_b")) -> DataFrame:
    """Entity effects of two fits side by side with their difference."""
    left = a.select(entity, F.col("fe").alias(names[0]))
    out = left.join(b.select(entity, F.col("fe").alias(names[1])), entity)
    diff = F.col(names[0]) - F.col(names[1])
    return out.withColumns({"diff": diff, "abs_diff": F.abs(diff)})
