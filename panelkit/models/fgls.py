"""General feasible GLS for panels of any length: tiled covariance, tiled Cholesky.

The residual covariance of T times is a table of tiles of ``TILE`` x ``TILE`` values,
(i, j) with i >= j. Nothing holds T x T values: sums of residual products are made tile
by tile, and the Cholesky factor is made column of tiles by column of tiles, each
step a join of the tiles still to do with the column just finished.

An entity without some of the times has the covariance of its own times. Entities
with the same times share one factor. A missing time is a row and a column of
zeros; as in a generalised Cholesky decomposition, a pivot that is not positive is
left out together with its row. That covers the missing times, and
the time that demeaning makes redundant.

The rows of an entity are the right-hand sides: with W = L^-1 Z only W'W counts,
k + 1 numbers squared, and it is added up block by block as the factor's columns
are finished.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.slices import join_spread
from ..session import cut_lineage, drop_table
from .gram import inverse_spd, solve_spd
from .linear import LinearFit, within

TILE = 256
PIVOT = 1e-10  # of the largest variance; smaller pivots are left out
HELD_TILES = 16  # tiles that a task adds up before it passes them on
GROUP_VALUES = 1 << 21  # values of the entities that one task solves at once
SALTS = 32


@contextmanager
def small_batches(spark: SparkSession, rows: int = 8):
    """Rows that carry whole tiles go to the Python workers a few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def entities_at_once(times: int) -> int:
    """Rows per batch where a row holds all values of an entity."""
    return max(1, min(10_000, GROUP_VALUES // times))


def inverse_factor(a: np.ndarray, floor: float) -> np.ndarray:
    """L^-1 of a symmetric block; rows of pivots up to ``floor`` are zero."""
    n = len(a)
    work, low, out = a.copy(), np.zeros((n, n)), np.zeros((n, n))
    for j in range(n):
        if work[j, j] > floor:
            low[j:, j] = work[j:, j] / np.sqrt(work[j, j])
            work[j:, j:] -= np.outer(low[j:, j], low[j:, j])
            out[j] = -low[j, :j] @ out[:j]
            out[j, j] += 1.0
            out[j] /= low[j, j]
    return out


def _tile(values, b: int) -> np.ndarray:
    return np.asarray(values, dtype=float).reshape(b, b)


def entity_rows(first: LinearFit, t: str, b: int) -> tuple[DataFrame, int]:
    """(p, share, ts, z, u) per entity, and the number of tiles across T.

    p names the set of times, z holds the demeaned covariates and y row by row.
    """
    cols = [*first.xs, first.y]
    scored = first.scored().select(first.entity, F.col(t).cast("long").alias("_t"), *cols, "resid")
    low, high, n = scored.agg(F.min("_t"), F.max("_t"), F.count(F.lit(1))).first()
    minus = [(F.col(c) - F.lit(first.means[c])).alias(f"_x{i}") for i, c in enumerate(cols)]
    rows = scored.select(first.entity, (F.col("_t") - low).cast("int").alias("_t"), *minus, "resid")
    names = [f"_x{i}" for i in range(len(cols))]
    # an entity has one row per time, so its list is no longer than the time axis
    rows = rows.groupBy(first.entity).agg(F.sort_array(F.collect_list(F.struct("_t", "resid", *names))).alias("r"))
    q = len(cols)
    shares = max(1, -(-n * q // GROUP_VALUES))

    def demeaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = [np.column_stack([np.asarray(v, float) for v in row]) for row in zip(*[pdf[c] for c in names], strict=True)]
            out = pdf[["p", "share", "ts", "u"]].copy()
            out["z"] = [(x - x.mean(axis=0)).ravel() for x in z]
            yield out

    field = lambda c: F.transform("r", lambda x: x[c])
    out = rows.select(field("_t").alias("ts"), field("resid").alias("u"), F.pmod(F.xxhash64(first.entity), F.lit(shares)).alias("share"), *[field(c).alias(c) for c in names])
    out = out.withColumn("p", F.md5(F.col("ts").cast("string").cast("binary")))
    out = out.mapInPandas(demeaned, "p string, share long, ts array<int>, u array<double>, z array<double>")
    with small_batches(out.sparkSession, entities_at_once(high - low + 1)):
        return cut_lineage(out), (high - low) // b + 1


def _stream_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the arrays of rows that come sorted by (i, j)."""
    key, num, cnt = None, None, None
    shown = lambda: pd.DataFrame({"i": [key[0]], "j": [key[1]], "num": [num], "cnt": [cnt]})
    for pdf in batches:
        for i, j, a, c in zip(pdf["i"], pdf["j"], pdf["num"], pdf["cnt"], strict=True):
            if (i, j) == key:
                num, cnt = num + np.asarray(a), cnt + np.asarray(c)
            else:
                if key is not None:
                    yield shown()
                key, num, cnt = (i, j), np.asarray(a), np.asarray(c)
    if key is not None:
        yield shown()


def covariance_tiles(entities: DataFrame, tiles: int, b: int) -> DataFrame:
    """(i, j, v): mean residual products over the entities that have both times; zero where none has."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        several = entities_at_once(tiles * b)

        def flush() -> Iterator[pd.DataFrame]:
            for (i, j), (num, cnt) in held.items():
                yield pd.DataFrame({"i": [i], "j": [j], "num": [num.ravel()], "cnt": [cnt.ravel()]})
            held.clear()

        for pdf in batches:
            for at in range(0, len(pdf), several):
                part = pdf.iloc[at : at + several]
                u, seen = np.zeros((len(part), tiles * b)), np.zeros((len(part), tiles * b))
                for row, (ts, us) in enumerate(zip(part["ts"], part["u"], strict=True)):
                    u[row, ts], seen[row, ts] = us, 1.0
                for i in range(tiles):
                    for j in range(i + 1):
                        x, y = slice(i * b, (i + 1) * b), slice(j * b, (j + 1) * b)
                        if not (seen[:, x].any() and seen[:, y].any()):
                            continue
                        if (i, j) not in held and len(held) >= HELD_TILES:
                            yield from flush()
                        num, cnt = held.setdefault((i, j), [np.zeros((b, b)), np.zeros((b, b))])
                        num += u[:, x].T @ u[:, y]
                        cnt += seen[:, x].T @ seen[:, y]
        yield from flush()

    schema = "i int, j int, num array<double>, cnt array<double>"
    spark = entities.sparkSession
    with small_batches(spark, entities_at_once(tiles * b)):
        parts = entities.select("ts", "u").mapInPandas(products, schema)
        parts = written = cut_lineage(parts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
    for keys in (["i", "j", "salt"], ["i", "j"]):  # a tile's partial sums are added up in shares first
        parts = parts.repartition(*keys).sortWithinPartitions(*keys).select("i", "j", "num", "cnt").mapInPandas(_stream_sums, schema)
    ratio = F.zip_with("num", "cnt", lambda s, n: F.coalesce(F.try_divide(s, n), F.lit(0.0)))
    with small_batches(spark):
        out = cut_lineage(parts.select("i", "j", ratio.alias("v")))
    drop_table(written)
    return out


def largest_variance(omega: DataFrame, b: int) -> float:
    diagonal = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda k: F.get("v", k * (b + 1)))
    return float(omega.filter("i = j").agg(F.max(F.array_max(diagonal))).first()[0])


def pattern_tiles(entities: DataFrame, omega: DataFrame, tiles: int, b: int) -> DataFrame:
    """(p, i, j, v): for every set of times the tiles with zeros in the rows and columns of missing times."""
    patterns = entities.groupBy("p").agg(F.first("ts").alias("ts"))  # equal for equal p
    blocks = patterns.withColumn("blocks", F.array_distinct(F.transform("ts", lambda t: F.floor(t / b).cast("int"))))
    pairs = blocks.withColumn("i", F.explode("blocks")).withColumn("j", F.explode(F.filter("blocks", lambda j: j <= F.col("i"))))
    of = lambda block: F.transform(F.filter("ts", lambda t: F.floor(t / b) == F.col(block)), lambda t: t % b)
    pairs = pairs.select("p", "i", "j", of("i").alias("rows"), of("j").alias("cols"), (F.col("i") * tiles + F.col("j")).alias("at"))
    both = join_spread(pairs, omega.select((F.col("i") * tiles + F.col("j")).alias("at"), "v"), "at")

    def masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rows, cols, v in zip(pdf["rows"], pdf["cols"], pdf["v"], strict=True):
                a = np.zeros((b, b))
                a[np.ix_(rows, cols)] = _tile(v, b)[np.ix_(rows, cols)]
                out.append(a.ravel())
            yield pd.DataFrame({"p": pdf["p"], "i": pdf["i"], "j": pdf["j"], "v": out})

    return cut_lineage(both.select("p", "i", "j", "rows", "cols", "v").mapInPandas(masked, "p string, i int, j int, v array<double>"))


def factor_column(left: DataFrame, k: int, b: int, floor: float) -> DataFrame:
    """(p, i, v): column k of the factor; v is L_ik, and for i = k the inverse of L_kk."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple[str | None, np.ndarray | None] = (None, None)
        for pdf in batches:
            out = []
            for p, i, v, d in zip(pdf["p"], pdf["i"], pdf["v"], pdf["d"], strict=True):
                if p != known[0]:
                    known = p, inverse_factor(_tile(d, b), floor)
                out.append((known[1] if i == k else _tile(v, b) @ known[1].T).ravel())
            yield pd.DataFrame({"p": pdf["p"], "i": pdf["i"], "v": out})

    column = left.filter(F.col("j") == k)
    both = column.join(column.filter(F.col("i") == k).select("p", F.col("v").alias("d")), "p")
    return cut_lineage(both.select("p", "i", "v", "d").mapInPandas(solve, "p string, i int, v array<double>"))


def trailing(left: DataFrame, column: DataFrame, k: int, b: int) -> DataFrame:
    """The tiles behind column k, less the products of its tiles."""
    done = column.filter(F.col("i") > k)
    rest = left.filter(F.col("j") > k)
    both = rest.join(done.select("p", "i", F.col("v").alias("li")), ["p", "i"], "left")
    both = both.join(done.select("p", F.col("i").alias("j"), F.col("v").alias("lj")), ["p", "j"], "left")

    def subtract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                v if x is None or y is None else (_tile(v, b) - _tile(x, b) @ _tile(y, b).T).ravel()
                for v, x, y in zip(pdf["v"], pdf["li"], pdf["lj"], strict=True)
            ]
            yield pd.DataFrame({"p": pdf["p"], "i": pdf["i"], "j": pdf["j"], "v": out})

    return cut_lineage(both.select("p", "i", "j", "v", "li", "lj").mapInPandas(subtract, "p string, i int, j int, v array<double>"))


def solve_entities(entities: DataFrame, column: DataFrame, k: int, b: int, q: int) -> DataFrame:
    """Entities less the block k, and rows that hold sums of W'W in ``m`` instead."""
    pairs = entities.select("p", F.col("share").alias("s")).distinct()
    panel = column.join(pairs, "p").select(F.col("p").alias("panel"), F.col("s").alias("s"), "i", "v")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: [] for c in ("p", "share", "ts", "z", "m")})
        if not len(left):
            return empty
        ts, z = [np.asarray(t, int) for t in left["ts"]], [np.asarray(x, float).reshape(-1, q) for x in left["z"]]
        factor = {int(i): _tile(v, b) for i, v in zip(right["i"], right["v"], strict=True)}
        if k not in factor:  # none of these times is in block k
            return left[["p", "share", "ts", "z"]].assign(m=None)
        # the entities of a group have the same times
        at = ts[0]
        here = (at >= k * b) & (at < (k + 1) * b)
        x = np.stack(z)
        w = np.einsum("ab,nbq->naq", factor[k][:, at[here] - k * b], x[:, here])
        m = np.einsum("naq,nar->qr", w, w)
        behind = at >= (k + 1) * b
        for i in np.unique(at[behind] // b):
            rows = at // b == i
            x[:, rows] -= np.einsum("ab,nbq->naq", factor[int(i)][at[rows] - i * b], w)
        sums = pd.DataFrame({"p": [left["p"].iloc[0]], "share": [left["share"].iloc[0]], "ts": [None], "z": [None], "m": [m.ravel()]})
        if not behind.any():
            return sums
        rest = pd.DataFrame({"p": left["p"].to_numpy(), "share": left["share"].to_numpy(), "ts": [at[behind]] * len(x), "z": [v.ravel() for v in x[:, behind]]})
        return pd.concat([rest.assign(m=None), sums], ignore_index=True)

    out = entities.select("p", "share", "ts", "z").groupBy("p", "share").cogroup(panel.groupBy("panel", "s"))
    return cut_lineage(out.applyInPandas(solve, "p string, share long, ts array<int>, z array<double>, m array<double>"))


def gls_products(entities: DataFrame, omega: DataFrame, tiles: int, b: int, q: int) -> np.ndarray:
    """sum over entities of Z' Omega_i^-1 Z, q x q."""
    total = np.zeros(q * q)
    with small_batches(entities.sparkSession):
        floor = PIVOT * largest_variance(omega, b)
        left, table = pattern_tiles(entities, omega, tiles, b), None
        for k in range(tiles):
            column = factor_column(left, k, b, floor)
            solved = solve_entities(entities, column, k, b, q)
            sums = solved.filter("m is not null").select(F.posexplode("m").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
            for r in sums.collect():  # q x q numbers
                total[r["at"]] += r["v"]
            behind = trailing(left, column, k, b) if k + 1 < tiles else None
            drop_table(column, left, *([table] if table else []))
            left, table, entities = behind, solved, solved.filter("m is null")
        drop_table(table)
    return total.reshape(q, q)


def fgls_within(df: DataFrame, y: str, xs: list[str], entity: str, t: str, tile: int = TILE) -> LinearFit:
    """General feasible GLS on demeaned data, with the residual covariance of every pair of times.

    Efficient only with many more entities than times; with fewer, the covariance
    is singular and only its leading independent part has weight.
    """
    first = within(df, y, xs, entity, [t])
    k = len(xs)
    rows, tiles = entity_rows(first, t, tile)
    omega = covariance_tiles(rows, tiles, tile)
    m = gls_products(rows, omega, tiles, tile, k + 1)
    drop_table(omega, rows)
    beta = solve_spd(m[:k, :k], m[:k, k])
    bread = inverse_spd(m[:k, :k])
    ent = first.sample.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_i"),
        (F.avg(y) - sum((F.lit(float(b)) * F.avg(x) for b, x in zip(beta, xs)), F.lit(0.0))).alias("fe"),
    )
    fit = LinearFit(
        "fgls", y, list(xs), list(xs), beta, bread, first.sigma2, first.n, first.df_resid, first.rss,
        first.tss, bread, first.sample, entity, first.n_entities, ent, first.means,
    )
    fit.rss = float(fit.scored().agg(F.sum(F.col("resid") * F.col("resid"))).first()[0])
    fit.sigma2 = fit.rss / fit.df_resid
    return fit
