"""Sums, cross products and the small solves behind every fit."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_table

# Above this many columns the cross products no longer fit one generated method
# (23 s against 1 s measured for 25 columns), so partitions add them up in numpy.
MAX_SQL_COLUMNS = 9
MERGED = 32  # R factors that one task merges
ILL = 1e8  # condition of the scaled cross products from which a fit goes by QR


@dataclass
class Moments:
    """n = sum w, s = sum w x, c = sum w x x'."""

    n: float
    s: np.ndarray
    c: np.ndarray

    def centred(self) -> np.ndarray:
        return self.c - np.outer(self.s, self.s) / self.n


def cross_sums(cols: list[Column], weight: Column | None = None) -> dict[str, Column]:
    """Aggregates for 1, x and x x' in a fixed order."""
    xs = [F.lit(1.0), *cols]
    w = weight if weight is not None else F.lit(1.0)
    return {
        f"_g{i}_{j}": F.sum(w * xs[i] * xs[j]) for i in range(len(xs)) for j in range(i, len(xs))
    }


def _to_moments(values: list[float], k: int) -> Moments:
    m = np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = [0.0 if v is None else v for v in values]
    m = m + np.triu(m, 1).T
    return Moments(m[0, 0], m[0, 1:], m[1:, 1:])


def moments(df: DataFrame, cols: list[Column], weight: Column | None = None) -> Moments:
    """One pass over the rows; only the (k+1)(k+2)/2 sums reach the driver."""
    k = len(cols)
    # each expression becomes a column first, so it is computed once per row
    names = [f"_x{i}" for i in range(k)]
    rows = df.select((weight if weight is not None else F.lit(1.0)).alias("_w"), *[c.alias(n) for n, c in zip(names, cols)])
    if k <= MAX_SQL_COLUMNS:
        w = F.col("_w") if weight is not None else None
        sums = cross_sums([F.col(n) for n in names], w)
        return _to_moments(list(rows.agg(*[c.alias(n) for n, c in sums.items()]).first()), k)
    upper = np.triu_indices(k + 1)

    def partial(batches: Iterator) -> Iterator:
        import pandas as pd

        total = np.zeros((k + 1, k + 1))
        for b in batches:
            a = b.to_numpy(dtype=float)
            w = a[:, 0].copy()
            a[:, 0] = 1.0
            total += a.T @ (a * w[:, None])
        yield pd.DataFrame({"i": np.arange(len(upper[0])), "v": total[upper]})

    sums = rows.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    return _to_moments([r["v"] for r in sorted(sums.collect(), key=lambda r: r["i"])], k)


def ill_conditioned(a: np.ndarray) -> bool:
    """Whether normal equations would lose more than half of all digits."""
    d = np.sqrt(np.clip(np.diag(a), 0, None))
    return not np.all(d > 0) or np.linalg.cond(a / np.outer(d, d)) > ILL


def triangle(df: DataFrame, cols: list[Column]) -> np.ndarray:
    """R of the QR decomposition of all rows: R'R = X'X without ever forming a product.

    Every task reduces its rows batch by batch to one R; ``MERGED`` of those make
    a new one, level by level, until one task's worth is left for the driver.
    """
    k = len(cols)
    rows = df.select(*[c.cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])

    def shown(r: np.ndarray):
        import pandas as pd

        return pd.DataFrame({"r": [np.vstack([r, np.zeros((k - len(r), k))]).ravel()]})

    def reduce_rows(batches: Iterator) -> Iterator:
        r = np.zeros((0, k))
        for b in batches:
            r = np.linalg.qr(np.vstack([r, b.to_numpy(dtype=float)]), mode="r")
        if len(r):
            yield shown(r)

    def merge(batches: Iterator) -> Iterator:
        r = np.zeros((0, k))
        for b in batches:
            for other in b["r"]:
                r = np.linalg.qr(np.vstack([r, np.asarray(other).reshape(k, k)]), mode="r")
        if len(r):
            yield shown(r)

    level = cut_lineage(rows.mapInPandas(reduce_rows, "r array<double>"))
    while (n := level.count()) > MERGED:
        merged = cut_lineage(level.repartition(-(-n // MERGED)).mapInPandas(merge, "r array<double>"))
        drop_table(level)
        level = merged
    top = [np.asarray(row["r"]).reshape(k, k) for row in level.collect()]  # at most MERGED
    drop_table(level)
    return np.linalg.qr(np.vstack([np.zeros((k, k)), *top]), mode="r")


def independent(r: np.ndarray, k: int, whole: np.ndarray, tol: float = 1e-7) -> tuple[list[int], np.ndarray]:
    """The first k columns that do not depend on those before them, and R of these and of the columns behind the k.

    A column depends if less than ``tol`` of its length is left beside the others,
    or no more than rounding of its length before effects were taken out (``whole``).
    """
    keep = list(range(r.shape[1]))
    for j in range(k):
        at = keep.index(j)
        small = np.linalg.qr(r[:, keep], mode="r")
        if abs(small[at, at]) <= max(tol * np.linalg.norm(small[: at + 1, at]), 1e-12 * whole[j]):
            keep.remove(j)
    return [j for j in keep if j < k], np.linalg.qr(r[:, keep], mode="r")


def solve_spd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve after scaling to a unit diagonal; collinear columns raise an error."""
    d = np.diag(a)
    if not np.all(d > 0):
        raise np.linalg.LinAlgError(f"no variation in column(s) {np.flatnonzero(~(d > 0)).tolist()}")
    d = np.sqrt(d)
    s = a / np.outer(d, d)
    if np.linalg.cond(s) > 1e13:
        raise np.linalg.LinAlgError("columns are collinear")
    return (np.linalg.solve(s, (b.T / d).T).T / d).T


def inverse_spd(a: np.ndarray) -> np.ndarray:
    return solve_spd(a, np.eye(len(a)))
