"""Global order, exact quantiles and positional choice without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

_ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def global_rank(df: DataFrame, keys: list[Column], rank: str = "rank", total: str | None = None) -> DataFrame:
    """1-based rank over the whole table.

    The table is range partitioned and sorted on ``keys`` (end them with a
    unique column, so equal values still split), then each partition's rows get
    the number of rows before it. The range split is checkpointed because a
    recomputed split could cut elsewhere. The running total covers one row per
    partition.
    """
    # no fixed number of partitions: adjacent small ranges may be merged at run time
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = cut_lineage(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _ROW_BITS)
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    ranged = ranged.select("*", part.alias("_part"), (row + 1).alias("_row"))
    sizes = ranged.groupBy("_part").agg(F.max("_row").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(every).alias("_total"),
    )
    out = ranged.join(F.broadcast(sizes), "_part")  # at most one row per partition
    out = out.withColumn(rank, F.col("_row") + F.col("_off"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_part", "_row", "_off", "_total", "_id")


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str]) -> DataFrame:
    """Exact interpolated (type 7) quantiles per group; nulls are skipped.

    Equal values are first counted together, so ties never pile up. The distinct
    values are range partitioned on (group, value): one group may span many
    partitions. Counts before each partition give every value its rank interval,
    and one aggregate per group picks the values at the wanted ranks.
    """
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranged = counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    run = Window.partitionBy("_part", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("_cum", F.sum("_c").over(run))
    sizes = ranged.groupBy("_part", *by).agg(F.max("_cum").alias("_n"))
    group = Window.partitionBy(*by).orderBy("_part")
    sizes = sizes.select(
        "_part",
        *by,
        F.coalesce(F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_N"),
    )
    # one row per (partition, group) it holds: no more than groups + partitions
    rows = ranged.join(sizes, ["_part", *by]).withColumn("_hi", F.col("_off") + F.col("_cum"))
    picks = []
    for name, p in probs.items():
        h = (F.col("_N") - 1) * F.lit(float(p))
        lo = F.floor(h) + 1
        hi = F.least(lo + 1, F.col("_N"))
        covers = lambda r: (F.col("_hi") - F.col("_c") < r) & (r <= F.col("_hi"))
        picks += [
            F.max(F.when(covers(lo), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when(covers(hi), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(h - F.floor(h)).alias(f"_w_{name}"),
        ]
    out = rows.groupBy(*by).agg(*picks)
    val = lambda n: F.col(f"_lo_{n}") + F.col(f"_w_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
    return out.select(*by, *[val(n).alias(n) for n in probs])


def entity_means(df: DataFrame, entity: str, y: str, name: str = "mean_y") -> DataFrame:
    return df.groupBy(entity).agg(F.avg(y).alias(name))


def rank_entities(df: DataFrame, entity: str, y: str, descending: bool = False) -> DataFrame:
    """Entities ranked by mean, nulls last, ties broken by the entity key."""
    m = F.col("mean_y")
    first = m.desc_nulls_last() if descending else m.asc_nulls_last()
    return global_rank(entity_means(df, entity, y), [first, F.col(entity).asc()], "rank", "n_entities")


def spaced_rank(i: int | Column, n: Column, length: int) -> Column:
    """The i-th (0-based) of ``length`` evenly spaced positions in 1..n, half-even."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.bround(F.lit(1.0) + i * (n - 1) / F.lit(float(length - 1)), 0).cast("long")


def pick_bottom_middle_top(ranked: DataFrame, k: int = 3, rank: str = "rank", total: str = "n_entities") -> DataFrame:
    """The k lowest, k middle and k highest rows (1-3, 49-51, 98-100 of 100 for k=3)."""
    r, n = F.col(rank), F.col(total)
    mid = F.floor(n / 2) - F.lit((k - 1) // 2)
    return ranked.filter((r <= k) | r.between(mid, mid + k - 1) | (r > n - k))


def pick_evenly_spaced(ranked: DataFrame, length: int, rank: str = "rank", total: str = "n_entities") -> DataFrame:
    """Rows at ``round(seq(1, n, length))``."""
    wanted = F.array(*[spaced_rank(i, F.col(total), length) for i in range(length)])
    return ranked.filter(F.array_contains(wanted, F.col(rank).cast("long")))


def sample_entities(df: DataFrame, entity: str, length: int) -> DataFrame:
    """Evenly spaced entities in the order of their keys."""
    ids = df.select(entity).distinct()
    return pick_evenly_spaced(global_rank(ids, [F.col(entity).asc()], "rank", "n_entities"), length)
