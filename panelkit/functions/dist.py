"""Tail probabilities and quantiles for small result tables (numpy only).

Used on coefficient tables and on the few distinct degrees of freedom of a
panel, not on panel rows.
"""

from __future__ import annotations

import math

import numpy as np


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ValueError(f"the tail at a={a}, b={b}, x={x} did not converge")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return front * h
    raise ValueError(f"the tail at a={a}, x={x} did not converge")


LARGE_DF = 1e5  # from here on the expansion around the normal is closer than the continued fraction


def t_two_sided(t: float, df: float) -> float:
    if df > LARGE_DF and math.isfinite(t):  # error of order 1 / df ** 2
        return normal_two_sided(t * (1 - 1 / (4 * df)) / math.sqrt(1 + t * t / (2 * df)))
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_upper(f: float, d1: float, d2: float) -> float:
    if d1 == 1 and f > 0:
        return t_two_sided(math.sqrt(f), d2)
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, k: float) -> float:
    return gamma_upper(k / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for 0 < p < 1 by bisection; nan for df <= 0."""
    if not df > 0:
        return float("nan")
    if p == 0.5:
        return 0.0
    tail = 2 * min(p, 1 - p)
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > tail else (lo, mid)
        if hi - lo <= 1e-15 * hi:
            break
    return math.copysign((lo + hi) / 2, p - 0.5)


def t_quantiles(p: float, dfs: np.ndarray) -> np.ndarray:
    return np.array([t_quantile(p, float(d)) for d in dfs])
