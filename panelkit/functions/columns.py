"""Column expressions: buckets, dummies, transforms, draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded_log(x: Column) -> Column:
    """ln(x), null for x <= 0 (such rows leave the estimation sample)."""
    return F.when(x > 0, F.ln(x))


def add_quadratic(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{col}_sq", F.col(col) * F.col(col))


def interval_label(t: Column, lo, hi, names=("before", "inside", "after")) -> Column:
    """Before, inside or after the closed range [lo, hi]; a null t is after."""
    return F.when(t < lo, names[0]).when((t >= lo) & (t <= hi), names[1]).otherwise(names[2])


# Rain intensity limits in inches per hour and their names.
RAIN_CUTS = [0.10, 0.30]
RAIN_LABELS = ["non", "light", "moderate", "heavy"]


def intensity_band(x: Column, cuts=RAIN_CUTS, labels=RAIN_LABELS) -> Column:
    """Zero, then right-closed bands (0, c1], (c1, c2], ..., above; null otherwise."""
    out = F.when(x == 0, labels[0])
    lo = 0.0
    for hi, lab in zip(cuts, labels[1:]):
        out = out.when((x > lo) & (x <= hi), lab)
        lo = hi
    return out.when(x > lo, labels[-1])


def cut_bins(x: Column, breaks: list[float], right: bool = False) -> Column:
    """Bin number 1.. for the breaks; null outside them."""
    out = None
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:]), start=1):
        cond = (x > lo) & (x <= hi) if right else (x >= lo) & (x < hi)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return out


def one_hot(df: DataFrame, col: str, levels: list, base=None) -> tuple[DataFrame, list[str]]:
    """Treatment contrasts from an explicit level list; returns the new names.

    A level that is not listed raises an error when the rows are read; a null
    stays null.
    """
    base = levels[0] if base is None else base
    names = {lv: f"{col}_{lv}" for lv in levels if lv != base}
    known = F.col(col).isNull() | F.col(col).isin(*levels)
    unlisted = F.raise_error(F.concat(F.lit(f"{col} has a level that is not listed: "), F.col(col).cast("string"))).cast("double")
    cols = {n: F.when(known, (F.col(col) == lv).cast("double")).otherwise(unlisted) for lv, n in names.items()}
    return df.withColumns(cols), list(names.values())


def add_coef_terms(terms: dict[str, float]) -> Column:
    """The linear predictor sum(b * column)."""
    out = F.lit(0.0)
    for name, b in terms.items():
        out = out + F.lit(float(b)) * F.col(name)
    return out


def quadratic_form(cols: list[str], m) -> Column:
    """x' M x for a small symmetric M, as one expression per row."""
    out = F.lit(0.0)
    for i, a in enumerate(cols):
        inner = F.lit(float(m[i][i])) * F.col(a)
        for j in range(i + 1, len(cols)):
            inner = inner + F.lit(2.0 * float(m[i][j])) * F.col(cols[j])
        out = out + F.col(a) * inner
    return out


def strip_prefix(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def entity_of_row_key(c: Column) -> Column:
    """Entity part of a row key ``<entity>-<year>-<month>-<day>``."""
    return F.regexp_replace(c, r"(.*)-[^-]+-[^-]+-[^-]+$", "$1")


def hash_uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) from the md5 of the parts: same value on every run and engine.

    52 bits (13 hex digits), so the quotient is an exact double.
    """
    h = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(1 << 52))


# Coefficients of the rational approximation of the normal
# quantile published by P. J. Acklam (relative error below 1.2e-9).
_ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
             1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
             6.680131188771972e01, -1.328068155288572e01, 1.0]
_ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
             3.754408661907416e00, 1.0]
_ACKLAM_TAIL = 0.02425


def _horner(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function."""
    mid = p - F.lit(0.5)
    r = mid * mid
    centre = _horner(_ACKLAM_A, r) * mid / _horner(_ACKLAM_B, r)
    tail = lambda q: _horner(_ACKLAM_C, q) / _horner(_ACKLAM_D, q)
    low = tail(F.sqrt(-2.0 * F.ln(p)))
    high = -tail(F.sqrt(-2.0 * F.ln(1.0 - p)))
    return F.when(p < _ACKLAM_TAIL, low).when(p > 1 - _ACKLAM_TAIL, high).otherwise(centre)


POISSON_FROM_ZERO = 700.0  # exp(-lambda) gets close to underflow above


def poisson_draw(lam: Column, u: Column) -> Column:
    """Poisson(lam) count made from the uniform u, as a long; exact at any mean.

    Probabilities are added up until they reach u: from zero upwards while
    exp(-lam) is a number, else from the mode outwards, one step up and one down
    in turn. Either order inverts u to the same distribution. Steps: lam from
    zero, a multiple of its root from the mode.
    """
    reach = F.ceil(12.0 * F.sqrt(lam) + 30.0).cast("int")
    # mean and uniform ride along in the state, so they are computed once per row
    p0 = F.exp(-lam)
    start = F.struct(
        F.lit(0).cast("long").alias("k"), p0.alias("p"), p0.alias("c"), lam.alias("lam"), u.alias("u")
    )

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * s["lam"] / i
        grown = F.struct(
            i.cast("long").alias("k"), p.alias("p"), (s["c"] + p).alias("c"), s["lam"].alias("lam"), s["u"].alias("u")
        )
        return F.when(s["c"] < s["u"], grown).otherwise(s)

    top = F.ceil(lam).cast("int") + reach
    upward = F.aggregate(F.sequence(F.lit(1), top), start, step, lambda s: s["k"])

    mode = F.floor(lam).cast("long")
    pm = F.exp(mode * F.ln(lam) - lam - log_factorial(mode))
    middle = F.struct(
        mode.alias("k"), mode.alias("hi"), pm.alias("ph"), mode.alias("lo"), pm.alias("pl"), pm.alias("c"),
        lam.alias("lam"), u.alias("u"),
    )

    def outward(s: Column, i: Column) -> Column:
        up = i % 2 == 1
        ph = F.when(up, s["ph"] * s["lam"] / (s["hi"] + 1)).otherwise(s["ph"])
        pl = F.when(up, s["pl"]).otherwise(s["pl"] * s["lo"] / s["lam"])  # zero below zero
        hi, lo = F.when(up, s["hi"] + 1).otherwise(s["hi"]), F.when(up, s["lo"]).otherwise(s["lo"] - 1)
        grown = F.struct(
            F.when(up, s["hi"] + 1).otherwise(F.greatest(s["lo"] - 1, F.lit(0).cast("long"))).alias("k"),
            hi.alias("hi"), ph.alias("ph"), lo.alias("lo"), pl.alias("pl"),
            (s["c"] + F.when(up, ph).otherwise(pl)).alias("c"), s["lam"].alias("lam"), s["u"].alias("u"),
        )
        return F.when(s["c"] < s["u"], grown).otherwise(s)

    around = F.aggregate(F.sequence(F.lit(1), 2 * reach), middle, outward, lambda s: s["k"])
    return F.when(lam.isNull() | u.isNull(), F.lit(None).cast("long")).when(lam <= POISSON_FROM_ZERO, upward).otherwise(around)


def log_factorial(n: Column) -> Column:
    """ln(n!) for a count: exact up to 20, Stirling series above (error < 1e-12)."""
    x = n.cast("double")
    stirling = (
        (x + 0.5) * F.ln(x) - x + F.lit(0.5 * math.log(2 * math.pi))
        + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5))
    )
    return F.when(n <= 20, F.ln(F.factorial(n.cast("int")).cast("double"))).otherwise(stirling)


def linspace(df: DataFrame, lo: Column, hi: Column, n: int, name: str) -> DataFrame:
    """Each row of ``df`` times ``n`` evenly spaced values from lo to hi."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return df.withColumn("_i", i).withColumn(
        name, lo + F.col("_i") * (hi - lo) / F.lit(float(n - 1))
    ).drop("_i")
