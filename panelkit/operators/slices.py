"""Ordered operations within an entity that do not need the entity in one task.

A panel entity is cut into slices of its integer time or position. Rows near a
slice border are copied into the neighbour slice (a halo), so a lag or a moving
frame is computed inside a slice. An entity that owns a third of all rows is
spread over many tasks; an entity shorter than one slice costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

SLICE_ROWS = 4096


def _slice_of(pos: Column, size: int) -> Column:
    return F.floor(pos / F.lit(size)).cast("long")


def with_halo(df: DataFrame, pos: str, before: int, after: int, size: int = SLICE_ROWS) -> DataFrame:
    """Copy each row to every slice that has a row looking at it.

    A row of the result looks back ``before`` and ahead ``after`` positions. Adds
    ``_slice`` and ``_core`` (true on the one copy that belongs to the slice).
    """
    size = max(size, 2 * (before + after))
    p = F.col(pos).cast("long")
    out = df.withColumn(
        "_slice", F.explode(F.sequence(_slice_of(p - F.lit(after), size), _slice_of(p + F.lit(before), size)))
    )
    return out.withColumn("_core", F.col("_slice") == _slice_of(p, size))


SPREAD = 8


def join_spread(rows: DataFrame, small: DataFrame, entity: str, spread: int = SPREAD) -> DataFrame:
    """Join one row per entity to many, with the rows of an entity dealt to ``spread`` tasks.

    ``small`` is copied per share, so a hot entity is not in one task when the
    join shuffles, and whatever aggregates by entity afterwards adds up shares.
    """
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(spread)).cast("int")
    copies = small.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return rows.withColumn("_share", share).join(copies, [entity, "_share"]).drop("_share")


def slice_window(entity: str, pos: str) -> WindowSpec:
    return Window.partitionBy(entity, "_slice").orderBy(pos)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_core", "_slice")


def lag_by_value(
    df: DataFrame, entity: str, pos: str, lags: dict[str, tuple[str, int]], size: int = SLICE_ROWS
) -> DataFrame:
    """``lags[name] = (column, k)``: the column at exactly ``pos - k``.

    Null when the entity has no row at that position. Negative k looks ahead.
    """
    ks = [k for _, k in lags.values()]
    out = with_halo(df, pos, max(0, *ks), max(0, *[-k for k in ks]), size)
    out = out.repartition(entity, "_slice")  # rows may come dealt by entity alone, which a window would accept
    w = slice_window(entity, pos)
    cols = {n: F.first(c).over(w.rangeBetween(-k, -k)) for n, (c, k) in lags.items()}
    return drop_halo(out.withColumns(cols))


def entity_position(
    df: DataFrame, entity: str, t: str, name: str = "pos", size: int = SLICE_ROWS
) -> DataFrame:
    """1-based row position within the entity in order of the integer ``t``.

    Positions come from a count per slice plus the row number in the slice; the
    running total runs over one row per (entity, slice).
    """
    keyed = df.withColumn("_slice", _slice_of(F.col(t), size))
    counts = keyed.groupBy(entity, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(entity).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(entity, "_slice", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    rn = F.row_number().over(slice_window(entity, t))
    out = keyed.withColumn(name, rn).join(offsets, [entity, "_slice"])
    return out.withColumn(name, F.col(name) + F.col("_off")).drop("_slice", "_off")


def lag_by_position(
    df: DataFrame, entity: str, t: str, lags: dict[str, tuple[str, int]], size: int = SLICE_ROWS
) -> DataFrame:
    """The column k observed rows earlier, whatever the time distance."""
    out = entity_position(df, entity, t, "_pos", size)
    return lag_by_value(out, entity, "_pos", lags, size).drop("_pos")
