"""Reading, deriving and writing panels (one row per entity and time)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.ranking import global_rank

# The columns of the two input files.
RAW_PANEL_SCHEMA = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("wind_speed", T.DoubleType()),
        T.StructField("precipitation", T.DoubleType()),
        T.StructField("snowfall", T.DoubleType()),
        T.StructField("snow_depth", T.DoubleType()),
        T.StructField("mean_temperature", T.DoubleType()),
        T.StructField("max_temperature", T.DoubleType()),
        T.StructField("min_temperature", T.DoubleType()),
    ]
)

COORDS_SCHEMA = T.StructType(
    [
        T.StructField("station", T.StringType()),
        T.StructField("long", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("FE", T.DoubleType()),
        T.StructField("scaled_FE", T.DoubleType()),
        T.StructField("scaled_FE_layered", T.IntegerType()),
        T.StructField("round.FE", T.DoubleType()),
        T.StructField("round.scaled_FE", T.DoubleType()),
    ]
)


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row; the string ``NA`` is null.

    A CSV file has its own column order, so the columns are matched by header
    name: the header line gives the order, ``schema`` gives the types. Columns
    that ``schema`` does not name (a row-number column, say) are left out. A file
    of the folder with another header, and a value that is not of its column's
    type, raise an error when the rows are read.
    """
    reader = spark.read.option("header", True).option("nullValue", "NA")
    reader = reader.option("enforceSchema", False).option("mode", "FAILFAST")
    types = {f.name: f.dataType for f in schema.fields}
    header = reader.csv(path).columns
    full = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    return reader.schema(full).csv(path).select(*[F.col(f"`{c}`") for c in types])


def write_panel(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None
) -> None:
    """Write a panel; CSV output has a header and writes null as ``NA``."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("nullValue", "NA").csv(path)
    else:
        w.format(fmt).save(path)


def panel_from_events(
    events: DataFrame, entity: str, time: Column, time_name: str, **aggs: Column
) -> DataFrame:
    """Count event rows per entity and period, with further aggregates.

    Partial aggregation runs before the shuffle, so an entity that holds a
    large share of the events sends one row per task and period.
    """
    extra = [c.alias(n) for n, c in aggs.items()]
    return events.groupBy(entity, time.alias(time_name)).agg(F.count(F.lit(1)).alias("y"), *extra)


def time_axis(df: DataFrame, time: str, name: str = "t", keep: dict[str, Column] | None = None) -> DataFrame:
    """Chronological 1..T ordinal of the distinct times, with time-level aggregates.

    Distinct dates are few (the calendar bounds them), so they are numbered in
    one window; distinct times of any other type go through the distributed rank.
    """
    aggs = [c.alias(n) for n, c in (keep or {}).items()]
    times = df.groupBy(time).agg(*aggs) if aggs else df.select(time).distinct()
    if isinstance(times.schema[time].dataType, T.DateType):
        return times.withColumn(name, F.row_number().over(Window.orderBy(time)))
    return global_rank(times, [F.col(time).asc()], name)


def attach_axis(df: DataFrame, axis: DataFrame, time: str) -> DataFrame:
    """Left join of the time table onto panel rows.

    A ``DATE`` column has at most some 3.6 million distinct values (years
    1-9999), so a per-date table is safe to broadcast. Any other type is left to
    the size-based choice of Spark.
    """
    if isinstance(axis.schema[time].dataType, T.DateType):
        axis = F.broadcast(axis)
    return df.join(axis, time, "left")


def enrich_with_overrides(
    keys: DataFrame, lookup: DataFrame, overrides: DataFrame, on: str, cols: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Attributes from a lookup table, gaps filled from a hand-made table.

    Returns (enriched keys, keys the lookup missed).
    """
    lk = lookup.select(on, *[F.col(c).alias(f"_l_{c}") for c in cols])
    ov = overrides.select(on, *[F.col(c).alias(f"_o_{c}") for c in cols])
    out = keys.join(lk, on, "left").join(ov, on, "left")
    out = out.select(*keys.columns, *[F.coalesce(f"_l_{c}", f"_o_{c}").alias(c) for c in cols])
    misses = keys.join(lookup, on, "left_anti")
    return out, misses
