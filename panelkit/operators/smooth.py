"""Moving averages, local regression, kernel smoothing, QQ points, splines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normal_quantile
from ..session import cut_lineage, drop_table
from . import local_lines
from .ranking import exact_quantiles, global_rank
from .slices import SLICE_ROWS, drop_halo, entity_position, join_spread, slice_window, with_halo


def moving_average(
    df: DataFrame, entity: str, t: str, y: str, widths: dict[str, int], size: int = SLICE_ROWS
) -> DataFrame:
    """Centred equal-weight averages over observed rows.

    Null at the edges and where the frame holds a null. An even width has one
    more row ahead than behind.
    """
    behind = {n: (w - 1) // 2 for n, w in widths.items()}
    ahead = {n: w // 2 for n, w in widths.items()}
    out = entity_position(df, entity, t, "_pos", size)
    out = with_halo(out, "_pos", max(behind.values()), max(ahead.values()), size)
    win = slice_window(entity, "_pos")
    cols = {}
    for n, w in widths.items():
        frame = win.rowsBetween(-behind[n], ahead[n])
        cols[n] = F.when(F.count(y).over(frame) == w, F.avg(y).over(frame))
    return drop_halo(out.withColumns(cols)).drop("_pos")


def kernel_smooth(
    df: DataFrame, x: str, y: str, bandwidth: float, by: list[str] | None = None, n_points: int | None = None
) -> DataFrame:
    """Nadaraya-Watson estimate with a normal kernel on an even grid over range(x).

    The kernel's quartiles lie at +-bandwidth/4 and it is cut at four standard
    deviations. The grid has ``n_points`` points, by default max(100, rows of the
    group). Grid points without data in reach are null.

    The grid is even, so the points a row reaches are an index interval: a row
    yields its own terms and partial sums run before the shuffle. No band join.
    Equal (group, x) rows are merged first.
    """
    by = list(by or [])
    sd = 0.25 / 0.6744897501960817 * float(bandwidth)  # upper normal quartile
    cut = F.lit(4.0 * sd)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.groupBy(*by, F.col(x).cast("double").alias("_x")).agg(
        F.sum(F.col(y).cast("double")).alias("_sy"), F.count(F.lit(1)).alias("_n")
    )
    m = F.lit(n_points).cast("long") if n_points else F.greatest(F.lit(100).cast("long"), F.sum("_n"))
    rng = rows.groupBy(*by).agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"), m.alias("_m"))
    rng = rng.withColumn("_step", (F.col("_b") - F.col("_a")) / (F.col("_m") - 1))
    if by:
        joined = rows.join(rng, by)
    else:  # a one-row table
        one = rng.select(F.struct("*").alias("_r")).scalar()
        joined = rows.withColumn("_r", one).select("*", "_r._a", "_r._b", "_r._m", "_r._step").drop("_r")
    last = F.col("_m") - 1

    def index(v: Column, default: Column) -> Column:
        i = F.try_divide(v - F.col("_a"), F.col("_step"))
        return F.least(last, F.greatest(F.lit(0).cast("long"), F.coalesce(i.cast("long"), default)))

    zero = F.lit(0).cast("long")
    lo = F.greatest(zero, index(F.col("_x") - cut, zero) - 1)
    hi = F.least(last, index(F.col("_x") + cut, last) + 1)
    terms = joined.withColumn("_i", F.explode(F.sequence(lo, hi)))
    terms = terms.withColumn("_d", F.abs(F.col("_x") - (F.col("_a") + F.col("_i") * F.col("_step"))))
    terms = terms.filter(F.col("_d") <= cut)
    u = F.col("_d") / F.lit(sd)
    terms = terms.withColumn("_w", F.exp(-0.5 * u * u))
    sums = terms.groupBy(*by, "_i").agg(
        F.sum(F.col("_w") * F.col("_sy")).alias("_num"), F.sum(F.col("_w") * F.col("_n")).alias("_den")
    )
    grid = rng.withColumn("_i", F.explode(F.sequence(zero, last)))
    out = grid.join(sums, [*by, "_i"], "left")
    return out.select(
        *by,
        F.col("_i").alias("point"),
        (F.col("_a") + F.col("_i") * F.col("_step")).alias("x0"),
        (F.col("_num") / F.col("_den")).alias("y_hat"),
    )


def residual_smooths(
    df: DataFrame, entity: str, resid: str, covariates: list[str], bandwidth: float, n_points: int | None = None
) -> DataFrame:
    """Residual against each covariate, smoothed per (entity, covariate) in one job."""
    long = df.select(entity, resid, *[F.col(c).cast("double").alias(c) for c in covariates]).unpivot(
        [entity, resid], covariates, "covariate", "x"
    )
    return kernel_smooth(long, "x", resid, bandwidth, [entity, "covariate"], n_points)


WHOLE_ROWS = 32_768  # rows of an entity that one task fits with all passes
BATCH_ROWS = 32_768  # rows of such entities that a task fits at once, and those of the last one
TILE_ROWS = 16_384  # rows of a longer entity that one task fits at once


def lowess(
    df: DataFrame,
    entity: str,
    t: str,
    y: str,
    span: float = 2 / 3,
    passes: int = 3,
    delta_share: float = 0.01,
    size: int = SLICE_ROWS,
    whole_rows: int = WHOLE_ROWS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Robust local-linear trend of y over the row index, per entity.

    Lines are fitted at anchor rows no more than ``delta_share`` of the index
    range apart and interpolated in between (the usual default; 0 fits at every
    row). The sums of a line come from prefix moments of blocks of rows
    (``local_lines``), so the work grows with the rows, whatever the span and the
    number of anchors. An entity of up to ``whole_rows`` rows is one task's work with all
    its passes, together with others of as many rows, from one table of weights as long
    as that stays small; a longer one is cut into tiles of ``tile_rows``, each of which gets its
    own rows, those at the ends of its windows, and the moments of all blocks.
    Rows with a null y, entity or t are left out before indexing.
    Returns (entity, t, pos, y, trend).
    """
    if delta_share < 0:
        raise ValueError("delta_share must not be negative")
    known = df.filter(F.col(y).isNotNull() & F.col(entity).isNotNull() & F.col(t).isNotNull())
    rows = cut_lineage(known.select(entity, t, F.col(y).cast("double").alias("_y")))  # positions and counts read it, the input is computed once
    base = entity_position(rows, entity, t, "_pos", size)
    n_of = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    k = F.least(n, F.greatest(F.lit(2), F.least(n, F.floor(F.lit(span) * n + 1e-7))))
    step = F.greatest(F.lit(1), F.floor(F.lit(delta_share) * (n - 1)))
    cur = cut_lineage(
        join_spread(base, n_of, entity).select(entity, t, "_pos", "_y", "_n", k.cast("long").alias("_k"), step.cast("long").alias("_step"))
    )
    drop_table(rows)
    out = _lowess_whole(cur.filter(n <= whole_rows), entity, passes)
    if cur.filter(n > whole_rows).limit(1).count():
        out = out.unionByName(_lowess_tiles(cur.filter(n > whole_rows), entity, passes, tile_rows))
    return out.select(entity, t, F.col("_pos").alias("pos"), F.col("_y").alias("y"), F.col("_fit").alias("trend"))


def _lowess_whole(cur: DataFrame, entity: str, passes: int) -> DataFrame:
    def of(table: pa.Table) -> pa.Table:
        n, k, step, y = (table[c].to_numpy() for c in ("_n", "_k", "_step", "_y"))
        starts = np.flatnonzero(np.diff(n, prepend=0))  # entities of as many rows follow each other
        fit = [
            local_lines.alike_entities(y[i:j].reshape(-1, n[i]), int(k[i]), int(step[i]), passes).ravel()
            for i, j in zip(starts, [*starts[1:], len(n)])
        ]
        number = lambda v: pa.array(v, from_pandas=True)  # noqa: E731  # NaN is null, as in the tiles
        table = table.set_column(table.column_names.index("_y"), "_y", number(y))
        return table.append_column("_fit", number(np.concatenate(fit)))

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(held)
            n = table["_n"].to_numpy()
            whole = rows - int((n == n[-1]).sum()) % int(n[-1])  # the last entity may go on in the next batch
            if whole:
                yield from of(table.slice(0, whole)).to_batches()
            held, rows = table.slice(whole).to_batches(), rows - whole
        if rows:
            yield from of(pa.Table.from_batches(held)).to_batches()

    rows = cur.repartition(entity).sortWithinPartitions("_n", entity, "_pos")
    return rows.mapInArrow(run, _with(cur, "_fit double"))


def _with(df: DataFrame, more: str) -> str:
    return ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes], more])


def _lowess_tiles(cur: DataFrame, entity: str, passes: int, tile_rows: int) -> DataFrame:
    block = F.greatest(F.lit(local_lines.MIN_BLOCK), F.least(F.lit(local_lines.MAX_BLOCK), F.ceil(F.col("_k") / 16))).cast("long")
    cur = cur.withColumns({"_size": block, "_rw": F.lit(1.0)})
    cur = cut_lineage(cur.withColumn("_b", F.floor((F.col("_pos") - 1) / F.col("_size"))))
    plan = cut_lineage(_tiles(cur, entity, tile_rows))
    for it in range(passes + 1):
        cur = _tiles_pass(cur, plan, entity, tile_rows)
        if it < passes:
            cur = _robust_weights(cur, entity)
    return cur.select(entity, *[c for c in cur.columns if c not in (entity, "_rw", "_size", "_b")])


def _tiles(cur: DataFrame, entity: str, tile_rows: int) -> DataFrame:
    """(entity, tile, block): the blocks whose rows a tile needs."""
    one = cur.groupBy(entity).agg(*[F.max(c).alias(c) for c in ("_n", "_k", "_step", "_size")])
    n, k, step, size = (F.col(c) for c in ("_n", "_k", "_step", "_size"))
    one = one.withColumn("_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / tile_rows))))
    c0 = F.greatest(F.lit(1), F.col("_tile") * tile_rows + 1 - step)
    c1 = F.least(n, (F.col("_tile") + 1) * tile_rows + step)
    left = lambda c: F.greatest(F.lit(1), F.least(n - k + 1, c - F.floor(k / 2)))
    slack = F.floor(k * local_lines.NEAR) + 2  # windows end a little inside, and the middle reaches a little out
    blocks = lambda a, b: F.sequence(F.floor((F.greatest(F.lit(1), a) - 1) / size), F.floor((F.least(n, b) - 1) / size))
    need = F.concat(blocks(c0 - slack, c1 + slack), blocks(left(c0), left(c1) + slack), blocks(left(c0) + k - 1 - slack, left(c1) + k - 1))
    return one.select(entity, "_tile", F.explode(F.array_distinct(need)).alias("_b"))


def _tiles_pass(cur: DataFrame, plan: DataFrame, entity: str, tile_rows: int) -> DataFrame:
    degree = local_lines.DEGREE
    u = (F.col("_pos") - (F.col("_b") * F.col("_size") + (F.col("_size") + 1) / 2)) / F.col("_k")
    power = [F.col("_rw")]
    for m in range(1, degree):
        power.append(F.col("_rw") * F.pow(u, F.lit(float(m))))
    sums = [F.sum(p * v) for v in (F.lit(1.0), F.col("_y")) for p in power]
    whole = cur.groupBy(entity, "_b").agg(F.array(*sums).alias("m"))
    whole = whole.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("_b", "m"))).alias("m"))  # one row per block, not per row
    whole = whole.select(F.col(entity).alias("_e"), F.flatten(F.transform("m", lambda x: x["m"])).alias("m"))
    tiles = plan.select(F.col(entity).alias("_e"), F.col("_tile").alias("_of")).distinct().join(whole, "_e")
    rows = plan.join(cur, [entity, "_b"])
    shown = [c for c in cur.columns if c != entity]

    def fit(left, right):
        pdf = left.sort_values("_pos")
        n, k, step, size, tile = (int(pdf[c].iloc[0]) for c in ("_n", "_k", "_step", "_size", "_tile"))
        pos, y = pdf["_pos"].to_numpy(), pdf["_y"].to_numpy()
        known, run = local_lines.running(pos, y, pdf["_rw"].to_numpy(), pdf["_b"].to_numpy(), size, k)
        moments = np.asarray(right["m"].iloc[0], float).reshape(-1, 2, degree)
        own = (pos > tile * tile_rows) & (pos <= (tile + 1) * tile_rows)
        v = local_lines.fitted(local_lines.Rows(n, k, size, known, run, moments), pos[own], y[own], step)
        return pdf.loc[own, [entity, *shown]].assign(_fit=v)

    out = rows.groupBy(entity, "_tile").cogroup(tiles.groupBy("_e", "_of")).applyInPandas(fit, _with(cur.select(entity, *shown), "_fit double"))
    return cut_lineage(out)


def _robust_weights(fit: DataFrame, entity: str) -> DataFrame:
    """Bisquare weights from six times the entity's median absolute residual."""
    res = cut_lineage(fit.withColumn("_res", F.abs(F.col("_y") - F.col("_fit"))))
    mad = exact_quantiles(res, "_res", {"_mad": 0.5}, [entity])
    mean = res.groupBy(entity).agg(F.avg("_res").alias("_mean"))
    res = res.join(mad.join(mean, entity), entity)
    c = 6 * F.col("_mad")
    q = F.try_divide(F.col("_res"), c)
    bisq = F.pow(1 - q * q, 2)
    w = (
        F.when(c < 1e-7 * F.col("_mean"), F.col("_rw"))
        .when(F.col("_res") <= local_lines.NEAR * c, 1.0)
        .when(F.col("_res") <= local_lines.FAR * c, bisq)
        .otherwise(0.0)
    )
    return res.withColumn("_rw", w).drop("_res", "_mad", "_mean", "_fit")


def qq_points(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Sorted values against normal quantiles.

    ``keys`` identify a row and split equal values. Adds ``theoretical``.
    """
    ranked = global_rank(
        df.filter(F.col(value).isNotNull()), [F.col(value).asc(), *[F.col(k).asc() for k in keys]], "rank", "_n"
    )
    n = F.col("_n")
    a = F.when(n <= 10, 0.375).otherwise(0.5)
    return ranked.withColumn("theoretical", normal_quantile((F.col("rank") - a) / (n + 1 - 2 * a))).drop("_n")


def qq_line(df: DataFrame, value: str) -> DataFrame:
    """Slope and intercept of the line through the quartiles."""
    z = 0.6744897501960817
    q = exact_quantiles(df, value, {"q1": 0.25, "q3": 0.75}, [])
    slope = (F.col("q3") - F.col("q1")) / (2 * z)
    return q.select(slope.alias("slope"), (F.col("q1") + z * slope).alias("intercept"))


def spline_coefficients(x: list[float], y: list[float]) -> np.ndarray:
    """Cubic spline through a dozen or fewer knots, one row (x, y, b, c, d) per knot.

    End conditions: the third derivative at each end is that of the cubic
    through the four end knots (Forsythe, Malcolm and Moler 1977), so a cubic is
    reproduced. The value is y + b u + c u^2 + d u^3 with u the distance to the knot.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = s[i] - s[i - 1]

    def third(i: int) -> float:
        """Third divided difference of the four knots from i on."""
        d = y[i : i + 4]
        for k in (1, 2, 3):
            d = (d[1:] - d[:-1]) / (x[i + k : i + 4] - x[i : i + 4 - k])
        return float(d[0])

    a[0, :2] = -h[0], h[0]
    a[-1, -2:] = h[-1], -h[-1]
    if n > 3:
        r[0] = h[0] ** 2 * third(0)
        r[-1] = -(h[-1] ** 2) * third(n - 4)
    e = np.linalg.solve(a, r)  # second derivative / 6
    b = s - h * (e[1:] + 2 * e[:-1])
    d = np.diff(e) / h
    u = h[-1]
    b = np.append(b, b[-1] + 6 * e[-2] * u + 3 * d[-1] * u * u)
    return np.column_stack([x, y, b, 3 * e, np.append(d, d[-1])])


def spline_value(x0: Column, coefs: np.ndarray) -> Column:
    """The spline as a Column; outside the knots the end pieces go on."""
    out = None
    for xk, yk, b, c, d in reversed(coefs.tolist()):
        u = x0 - F.lit(xk)
        v = F.lit(yk) + u * (F.lit(b) + u * (F.lit(c) + u * F.lit(d)))
        out = v if out is None else F.when(x0 < F.lit(nxt), v).otherwise(out)
        nxt = xk
    return out


def month_effect_spline(spark, month_effects: dict[int, float], skip: int, days: int = 31) -> DataFrame:
    """Daily effects for the left-out month, from a spline through the other months.

    Month m has its knot at m + 0.5; the grid has ``days`` points per knot over
    the knot range. The grid points strictly inside (skip, skip+1) are the day
    effects: (day, x0, effect).
    """
    months = sorted(m for m in month_effects if m != skip)
    coefs = spline_coefficients([m + 0.5 for m in months], [month_effects[m] for m in months])
    lo, hi, n = months[0] + 0.5, months[-1] + 0.5, days * len(months)
    grid = spark.range(n).select(
        F.col("id"), (F.lit(lo) + F.col("id") * F.lit((hi - lo) / (n - 1))).alias("x0")
    )
    first = np.searchsorted(np.linspace(lo, hi, n), skip, side="right")
    grid = grid.filter((F.col("x0") > skip) & (F.col("x0") < skip + 1))
    day = (F.col("id") - F.lit(int(first)) + 1).cast("int")
    return grid.select(day.alias("day"), "x0", spline_value(F.col("x0"), coefs).alias("effect"))
