"""Lagged panel columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import SLICE_ROWS, lag_by_position, lag_by_value


def gap_aware_lags(
    df: DataFrame, entity: str, t: str, y: str, lags: dict[str, int], size: int = SLICE_ROWS
) -> DataFrame:
    """y at exactly t-k of the same entity; null when that time is absent or y is null."""
    return lag_by_value(df, entity, t, {n: (y, k) for n, k in lags.items()}, size)


def gap_aware_lag_by_join(df: DataFrame, entity: str, t: str, y: str, k: int, name: str) -> DataFrame:
    """The same lag as a self equi-join on (entity, t), a unique key, so never skewed."""
    past = df.select(entity, (F.col(t) + k).alias(t), F.col(y).alias(name))
    return df.join(past, [entity, t], "left")


def observed_lags(
    df: DataFrame, entity: str, t: str, y: str, lags: dict[str, int], size: int = SLICE_ROWS
) -> DataFrame:
    """y of the k-th observed row before, whatever the gap."""
    return lag_by_position(df, entity, t, {n: (y, k) for n, k in lags.items()}, size)
