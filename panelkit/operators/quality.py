"""Checks and repairs of panel tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import exact_quantiles
from .slices import SLICE_ROWS, lag_by_position


def _melt(df: DataFrame, ids: list[str], cols: list[str], var: str, val: str) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, cols, var, val)


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min, quartiles, mean, max and null count per numeric column."""
    long = _melt(df, [], cols, "column_name", "v")
    stats = long.groupBy("column_name").agg(
        F.min("v").alias("min"),
        F.avg("v").alias("mean"),
        F.max("v").alias("max"),
        F.sum(F.col("v").isNull().cast("long")).alias("n_null"),
    )
    q = exact_quantiles(long, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["column_name"])
    return stats.join(q, "column_name", "left").select(
        "column_name", "min", "q1", "median", "mean", "q3", "max", "n_null"
    )


def panel_balance(df: DataFrame, entity: str) -> DataFrame:
    """How many entities have how many rows, with percentages."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"))
    hist = per.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_entities"))
    total = hist.agg(F.sum("n_entities")).scalar()
    return hist.withColumn("share", F.col("n_entities") / total)


def incomplete_entities(df: DataFrame, entity: str, n_times: int | Column, exact: bool = False) -> DataFrame:
    """Entities with fewer than (or exactly) ``n_times`` rows."""
    n_times = F.lit(n_times) if isinstance(n_times, int) else n_times
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"))
    n = F.col("n_rows")
    return per.filter(n == n_times if exact else n < n_times)


def consistency_check(df: DataFrame, by: str, cols: list[str], count_null: bool = True) -> DataFrame:
    """(column, group) pairs with more than one distinct value.

    A null counts as one value unless ``count_null`` is false. The values of a
    (column, group) are reduced to distinct ones first, so a date shared by all
    entities does not gather its rows in one task.
    """
    long = _melt(df, [by], cols, "column_name", "v")
    if not count_null:
        long = long.filter(F.col("v").isNotNull())
    return (
        long.distinct()
        .groupBy("column_name", by)
        .agg(F.count(F.lit(1)).alias("n_values"))
        .filter("n_values > 1")
    )


def gap_runs(df: DataFrame, entity: str, t: str, n_times: int | None = None, size: int = SLICE_ROWS) -> DataFrame:
    """Runs of missing times: first, last, length.

    With ``n_times``, the axis is 1..n_times and the runs before an entity's first
    and after its last row count too, so lengths add up to all missing times;
    without it, only runs between two rows.
    """
    if n_times is not None:
        kind = dict(df.dtypes)[t]
        ends = df.select(entity).distinct().select(entity, F.explode(F.array(F.lit(0), F.lit(n_times + 1)).cast(f"array<{kind}>")).alias(t))
        df = df.select(entity, t).union(ends)
    prev = lag_by_position(df.select(entity, t), entity, t, {"_prev": (t, 1)}, size)
    gap = F.col(t) - F.col("_prev") - 1
    return prev.filter(gap > 0).select(
        entity,
        (F.col("_prev") + 1).alias("gap_start"),
        (F.col(t) - 1).alias("gap_end"),
        gap.alias("gap_len"),
    )


def missing_times(df: DataFrame, entity: str, t: str, n_times: int | Column, size: int = SLICE_ROWS) -> DataFrame:
    """All (entity, t) of the axis 1..n_times without a row.

    Built per (entity, slice of the axis): the slice's full range minus the times
    seen in it. No entity-by-time product is joined; only the answer is produced.
    """
    last = F.lit(n_times) if isinstance(n_times, int) else n_times
    sl = F.floor((F.col(t) - 1) / F.lit(size)).cast("int")
    keys = df.select(entity, F.col(t).cast("int").alias("_t"), sl.alias("_slice"))
    seen = keys.groupBy(entity, "_slice").agg(F.collect_set("_t").alias("_seen"))  # <= size values
    every = (
        df.select(entity)
        .distinct()
        .withColumn("_last", last.cast("int"))
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.floor((F.col("_last") - 1) / F.lit(size)).cast("int"))))
    )
    lo = F.col("_slice") * size + 1
    full = F.sequence(lo, F.least(lo + (size - 1), F.col("_last")))
    none = F.array().cast("array<int>")
    out = every.join(seen, [entity, "_slice"], "left")
    return out.select(entity, F.explode(F.array_except(full, F.coalesce("_seen", none))).alias(t))


def first_observed(df: DataFrame, entity: str, time: str) -> DataFrame:
    return df.groupBy(entity).agg(F.min(time).alias(f"first_{time}"))


def sentinel_to_null(df: DataFrame, col: str, sentinel=-1) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) != sentinel, F.col(col)))


def fill_from_group(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """Null becomes the value the group agrees on (run ``consistency_check`` before).

    One value per group is aggregated with map-side combine and joined back, in
    place of a window that would gather all rows of a date.
    """
    known = df.groupBy(by).agg(*[F.max(c).alias(f"_g_{c}") for c in cols])
    if dict(df.dtypes)[by] == "date":
        known = F.broadcast(known)  # one row per calendar date
    out = df.join(known, by, "left")
    return out.select(*[F.coalesce(c, f"_g_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def drop_nulls(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop("any", subset=subset)


def null_indicator(df: DataFrame, col: str, name: str = "missing_indicator") -> DataFrame:
    return df.withColumn(name, F.col(col).isNull())


def null_count_per_entity(df: DataFrame, entity: str, col: str) -> DataFrame:
    return df.groupBy(entity).agg(F.sum(F.col(col).isNull().cast("long")).alias("n_null"))


def distinct_values(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    return (df.filter(where) if where is not None else df).select(col).distinct()


def no_nulls(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
