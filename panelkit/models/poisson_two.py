"""Poisson regression with two large sets of effects, without dummies.

The mean is a_i g_c exp(x'b). For given slopes the multipliers of one side follow
from those of the other in closed form, a_i = y_i / sum_c E_ic g_c and the same for g,
where E_ic adds up exp(x'b) over the rows of a cell (i, c). So a step of Newton's
method first reduces the rows to cells and then sweeps between the two sides on
the cells: one partial aggregate per side. The same sweeps, with the same weights,
take both effects out of the covariates, which the Hessian needs. Sweeps are
extrapolated (squared steps) and start from where the last step of Newton's
method expects the multipliers.

The second side's multipliers are a table with a row per level; no list of levels
exists anywhere. Levels without a count have multiplier zero: they add nothing to
the estimate and are absent from the effects.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import add_coef_terms
from ..operators.slices import join_spread
from ..session import cut_lineage, drop_table
from .glm import _exp_index
from .gram import inverse_spd, moments, solve_spd
from .linear import _keep, _shifted, _shifts, estimation_sample

MAX_STEPS, MAX_SWEEPS = 25, 500
TOL = 1e-10


@dataclass
class TwoWayFit:
    """Slopes on the driver; effects and rows on the cluster."""

    y: str
    xs: list[str]
    beta: np.ndarray
    hessian: np.ndarray
    n: int
    iterations: int
    sweeps: int
    sample: DataFrame
    entity: str
    other: str
    fixef: DataFrame  # entity, n_i, total, fe
    other_fixef: DataFrame  # other, n_i, total, fe: zero for its smallest level
    covariates: list[str] = field(default_factory=list)

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
        """Rows of levels with a positive total: fitted mean and residual."""
        out = join_spread(self.sample, self.fixef.select(self.entity, "fe"), self.entity)
        out = join_spread(out, self.other_fixef.select(self.other, F.col("fe").alias("fe_other")), self.other)
        lam = F.exp(add_coef_terms(self.slopes) + F.col("fe") + F.col("fe_other"))
        return out.withColumn("fitted", lam).withColumn("resid", F.col(self.y) - F.col("fitted"))

    def release(self) -> None:
        self.sample.unpersist()


def _cells(sample: DataFrame, xc: list[Column], beta: np.ndarray) -> DataFrame:
    """(i, c, E, S_j): sums of exp(x'b) and of exp(x'b) x_j over the rows of a cell."""
    # one column for the exponential, as in the one-way fit
    rows = sample.withColumn("_e", _exp_index(xc, beta))
    sums = [F.sum(F.col("_e") * c).alias(f"S{j}") for j, c in enumerate(xc)]
    return rows.groupBy("_i", "_c").agg(F.sum("_e").alias("E"), *sums)


def _side(cells: DataFrame, have: DataFrame, totals: DataFrame, at: str, to: str, k: int) -> DataFrame:
    """Multiplier and covariate means of the side ``to`` from those of the side ``at``.

    ``have`` has (at, m, p_j): multiplier, and the part of x_j given to that level.
    """
    rows = join_spread(cells, have, at)
    m = F.col("m")
    aggs = [F.sum(m * (F.col(f"S{j}") - F.col(f"p{j}") * F.col("E"))).alias(f"n{j}") for j in range(k)]
    sums = rows.groupBy(to).agg(F.sum(m * F.col("E")).alias("d"), *aggs).join(totals, to)
    parts = [F.coalesce(F.try_divide(f"n{j}", "d"), F.lit(0.0)).alias(f"p{j}") for j in range(k)]
    return sums.select(to, F.coalesce(F.try_divide("y", "d"), F.lit(0.0)).alias("m"), *parts)


def _sweep(cells: DataFrame, have: DataFrame, of: dict[str, DataFrame], k: int) -> DataFrame:
    """The next (_c, m, p_j), and in ``d_m`` and ``d_j`` how far each has moved."""
    new = _side(cells, _side(cells, have, of["_i"], "_c", "_i", k), of["_c"], "_i", "_c", k)
    parts = [f"p{j}" for j in range(k)]
    both = new.join(have.select("_c", *[F.col(c).alias(f"o_{c}") for c in ("m", *parts)]), "_c")
    log = F.when((F.col("m") > 0) & (F.col("o_m") > 0), F.ln(F.col("m") / F.col("o_m")))
    return both.select("_c", "m", *parts, log.alias("d_m"), *[(F.col(c) - F.col(f"o_{c}")).alias(f"d_{c}") for c in parts])


def _moved(swept: DataFrame, k: int) -> float:
    """The most that two levels with a count have moved apart; a move of all of them changes no mean."""
    d = ["d_m", *[f"d_p{j}" for j in range(k)]]
    r = swept.filter("m > 0").agg(*[f(c) for c in d for f in (F.max, F.min)]).first()
    return max(float(r[2 * j] or 0) - float(r[2 * j + 1] or 0) for j in range(k + 1))


def _extrapolated(g0: DataFrame, g1: DataFrame, g2: DataFrame, k: int) -> DataFrame:
    """Squared extrapolation of two sweeps, each part with its own step."""
    names = ["m", *[f"p{j}" for j in range(k)]]
    as_line = lambda g, t: g.select("_c", *[(F.ln("m") if c == "m" else F.col(c)).alias(f"{t}_{c}") for c in names])
    both = as_line(g0.filter("m > 0"), "a").join(as_line(g1.filter("m > 0"), "b"), "_c").join(as_line(g2.filter("m > 0"), "c"), "_c")
    r = {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in names}
    v = {c: F.col(f"c_{c}") - 2 * F.col(f"b_{c}") + F.col(f"a_{c}") for c in names}
    sizes = both.agg(*[F.sum(x[c] * x[c]) for c in names for x in (r, v)]).first()
    out = []
    for n, c in enumerate(names):
        rr, vv = sizes[2 * n] or 0.0, sizes[2 * n + 1] or 0.0
        step = max(1.0, (rr / vv) ** 0.5) if vv > 0 else 1.0
        line = F.col(f"a_{c}") + 2 * step * r[c] + step * step * v[c]
        out.append((F.exp(line) if c == "m" else line).alias(c))
    found = both.select("_c", *out)
    zero = [F.lit(0.0).alias(c) for c in names]
    return found.unionByName(g2.filter("m = 0").select("_c", *zero))


def poisson_two_way(
    df: DataFrame, y: str, xs: list[str], entity: str, other: str, keys: list[str] = (), tol: float = TOL
) -> TwoWayFit:
    """Poisson regression with effects of ``entity`` and ``other``, both of any number of levels."""
    sample = estimation_sample(df, y, xs, [entity, other, *keys]).withColumns({"_i": F.col(entity), "_c": F.col(other)})
    sample = _keep(sample)
    means = _shifts(sample, xs)
    xc, k = _shifted(xs, means), len(xs)
    totals = {s: cut_lineage(sample.groupBy(s).agg(F.sum(y).alias("y"), F.count(F.lit(1)).alias("n_i"))) for s in ("_i", "_c")}
    of = {s: t.select(s, "y") for s, t in totals.items()}
    g = cut_lineage(of["_c"].select("_c", F.when(F.col("y") > 0, 1.0).otherwise(0.0).alias("m"), *[F.lit(0.0).alias(f"p{j}") for j in range(k)]))
    beta, step, done, sweeps = np.zeros(k), float("inf"), 0, 0
    written = [g]

    def kept(table: DataFrame) -> DataFrame:
        written.append(cut_lineage(table))
        return written[-1]

    def settled(cells: DataFrame, start: DataFrame, close: float) -> DataFrame:
        nonlocal sweeps
        past, last = [start], float("inf")
        for _ in range(MAX_SWEEPS):
            past.append(kept(_sweep(cells, past[-1], of, k)))
            sweeps += 1
            moved = _moved(past[-1], k)
            if moved <= close:
                return past[-1]
            if len(past) == 3:
                # from where the second sweep led, if the last extrapolation made things worse
                past = [past[-1] if moved > 10 * last else kept(_extrapolated(*past, k))]
                last = moved
        raise RuntimeError(f"the effects have not settled within {MAX_SWEEPS} sweeps")

    while True:
        cells = kept(_cells(sample, xc, beta))
        close = min(1e-2, max(step * 1e-2, 1e-7))
        g = settled(cells, g, tol if step < tol else close)
        a = _side(cells, g, of["_i"], "_c", "_i", k)
        if step < tol:
            a = kept(a)
            break
        if done == MAX_STEPS:
            raise RuntimeError(f"no convergence within {MAX_STEPS} steps: the last one was {step:.3g}")
        rows = join_spread(sample, a.withColumnsRenamed({"m": "_a"} | {f"p{j}": f"_p{j}" for j in range(k)}), "_i")
        rows = join_spread(rows, g.select("_c", F.col("m").alias("_g"), *[F.col(f"p{j}").alias(f"_q{j}") for j in range(k)]), "_c")
        rows = rows.withColumn("_mu", F.col("_a") * F.col("_g") * _exp_index(xc, beta))
        left = [c - F.col(f"_p{j}") - F.col(f"_q{j}") for j, c in enumerate(xc)]
        ratio = F.coalesce(F.try_divide(F.col(y).cast("double"), F.col("_mu")), F.lit(0.0))
        m = moments(rows, [*left, ratio], F.col("_mu"))
        # against covariates without both effects, what the sweeps left counts only squared
        hess, grad = m.c[:k, :k], m.c[:k, k] - m.s[:k]
        d = solve_spd(hess, grad)
        beta, step, done = beta + d, float(np.max(np.abs(d))), done + 1
        drop_table(*[t for t in written if t is not g])
        written[:] = [g]
        # the multipliers follow the slopes
        shift = sum((F.lit(float(b)) * F.col(f"p{j}") for j, b in enumerate(d)), F.lit(0.0))
        g = g.withColumn("m", F.col("m") * F.exp(-shift)).select("_c", "m", *[f"p{j}" for j in range(k)])
    base = g.filter("m > 0").agg(F.min_by("m", "_c")).first()[0]
    shift = float(sum(b * means[x] for b, x in zip(beta, xs)))

    def effects(side: DataFrame, s: str, name: str, less: float) -> DataFrame:
        out = side.filter("m > 0").join(totals[s], s)
        return cut_lineage(out.select(F.col(s).alias(name), "n_i", F.col("y").alias("total"), (F.ln("m") - F.lit(less)).alias("fe")))

    fixef = effects(a, "_i", entity, shift - float(np.log(base)))
    other_fixef = effects(g, "_c", other, float(np.log(base)))
    drop_table(*written)
    fit = TwoWayFit(y, list(xs), beta, hess, 0, done, sweeps, sample.drop("_i", "_c"), entity, other, fixef, other_fixef, list(xs))
    fit.n = fit.scored().count()
    return fit
