"""Panel joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import missing_times


def join_scores(panel: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Residuals and fitted values onto panel rows by (entity, time)."""
    return panel.join(scored, keys, "inner")


def join_attribute(df: DataFrame, attrs: DataFrame, entity: str) -> DataFrame:
    return df.join(attrs, entity, "left")


def rows_of_entities(df: DataFrame, chosen: DataFrame, entity: str) -> DataFrame:
    return df.join(chosen.select(entity), entity, "left_semi")


def rows_not_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_anti")


def donor_rows(df: DataFrame, entity: str, t: str, n_times: int | Column, donor: DataFrame, cols: list[str]) -> DataFrame:
    """Missing (entity, t) cells with the time-level covariates of the donor table.

    ``donor`` has one row per t: a complete entity's rows or the time axis.
    """
    return missing_times(df, entity, t, n_times).join(donor.select(t, *cols), t, "left")


def xy_extract(
    df: DataFrame, entity: str, cols: list[str], chosen: DataFrame | None = None, where: Column | None = None
) -> DataFrame:
    """Columns of the chosen entities, optionally filtered, incomplete rows removed."""
    out = df.filter(where) if where is not None else df
    if chosen is not None:
        out = rows_of_entities(out, chosen, entity)
    return out.select(entity, *cols).na.drop("any", subset=cols)


def scenario_grid(template: DataFrame, col: str, lo: float, hi: float, n: int) -> DataFrame:
    """Every template row with ``col`` swept over n evenly spaced values.

    The n values are generated inside each row's task; no join takes place.
    """
    out = template.drop(col).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    step = F.lit(float(hi) - float(lo)) / F.lit(float(n - 1))
    return out.withColumn(col, F.lit(float(lo)) + F.col("_i") * step).drop("_i")
