"""Covariance matrices robust to clustering and unequal variances."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quadratic_form
from ..operators.slices import join_spread
from .glm import PoissonFit
from .gram import moments
from .linear import LinearFit


def score_meat(rows: DataFrame, scores: list[str], by: list[str]) -> tuple[np.ndarray, int]:
    """sum over clusters of (sum of scores)(sum of scores)', and the cluster count.

    Partial sums run before the shuffle, so a large cluster is one row per task.
    """
    sums = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in scores])
    m = moments(sums, [F.col(c) for c in scores])
    return m.c, int(round(m.n))


def vcov_arellano(fit: LinearFit) -> np.ndarray:
    """Entity-clustered covariance of the within slopes.

    Residuals add up to zero in each entity, so X'u needs no demeaned X.
    """
    rows = fit.scored()
    names = [f"_sc{i}" for i in range(len(fit.xs))]
    rows = rows.withColumns(
        {n: (F.col(x) - F.lit(fit.means[x])) * F.col("resid") for n, x in zip(names, fit.xs)}
    )
    meat, _ = score_meat(rows, names, [fit.entity])
    return fit.bread @ meat @ fit.bread


def vcov_white2_hc3(fit: LinearFit) -> np.ndarray:
    """One error variance per entity from leverage-adjusted residuals.

    X'X and the mean squared residual are aggregated together per entity and only
    entity rows are combined. The means come by a join that deals an entity's rows
    to several tasks, so the sums of a hot entity are partial ones.
    """
    sample = fit.scored()
    k = len(fit.xs)
    means = sample.groupBy(fit.entity).agg(*[F.avg(x).alias(f"_m{i}") for i, x in enumerate(fit.xs)])
    dm = [f"_d{i}" for i in range(k)]
    rows = join_spread(sample.select(fit.entity, "resid", *fit.xs), means, fit.entity)
    rows = rows.select(fit.entity, "resid", *[(F.col(x) - F.col(f"_m{i}")).alias(d) for i, (x, d) in enumerate(zip(fit.xs, dm))])
    adj = F.col("resid") / (1 - quadratic_form(dm, fit.bread))
    rows = rows.withColumn("_e2", adj * adj)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.groupBy(fit.entity).agg(F.avg("_e2").alias("_s2"), *[F.sum(F.col(dm[i]) * F.col(dm[j])).alias(f"_p{i}_{j}") for i, j in pairs])
    row = sums.agg(*[F.sum(F.col("_s2") * F.col(f"_p{i}_{j}")) for i, j in pairs]).first()
    meat = np.zeros((k, k))
    for (i, j), v in zip(pairs, row):
        meat[i, j] = meat[j, i] = v
    return fit.bread @ meat @ fit.bread


def vcov_poisson_cluster(fit: PoissonFit, by: list[str], n_coef: int | None = None) -> np.ndarray:
    """One- or two-way clustered covariance, V_a + V_b - V_ab.

    Small-sample factors: G/(G-1) with the smallest cluster count, and
    (N-1)/(N-K) with K the covariates plus one (the effects are nested in the
    clusters); pass ``n_coef`` for another K.
    """
    rows, names = fit.scores()
    rows = rows.select(*dict.fromkeys([*by, *names])).persist(StorageLevel.MEMORY_AND_DISK)  # read for each set of clusters
    bread = fit.vcov
    meat, g = score_meat(rows, names, by[:1])
    if len(by) == 2:
        m2, g2 = score_meat(rows, names, by[1:])
        m12, _ = score_meat(rows, names, by)
        meat, g = meat + m2 - m12, min(g, g2)
    rows.unpersist()
    k = n_coef if n_coef is not None else len(fit.covariates) + 1
    return bread @ meat @ bread * (g / (g - 1)) * ((fit.n - 1) / (fit.n - k))
