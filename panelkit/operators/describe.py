"""Grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import exact_quantiles


def mean_median(df: DataFrame, entity: str, y: str) -> DataFrame:
    """Mean and exact median per entity, nulls skipped."""
    means = df.groupBy(entity).agg(F.avg(y).alias("mean_y"))
    med = exact_quantiles(df, y, {"median_y": 0.5}, [entity])
    return means.join(med, entity, "left")


def compare_groups(df: DataFrame, label: Column, y: str, subset: list[str] | None = None) -> DataFrame:
    """Mean and sample variance of y per label; rows with nulls in ``subset`` are left out."""
    out = df.withColumn("label", label).na.drop("any", subset=subset or [y])
    return out.groupBy("label").agg(F.avg(y).alias("mean_y"), F.var_samp(y).alias("var_y"))


def above_mean_label(df: DataFrame, x: str, names=("above", "below")) -> Column:
    """Label against the mean over all rows of ``df`` (before any null drop)."""
    return F.when(F.col(x) > df.agg(F.avg(x)).scalar(), names[0]).otherwise(names[1])


def event_day_table(df: DataFrame, t: str, y: str, where: Column, keep: list[str]) -> DataFrame:
    """Mean y and the constant covariates of the days that meet a condition."""
    rows = df.filter(where).na.drop("any", subset=[y, *keep])
    return rows.groupBy(t).agg(F.avg(y).alias("mean_y"), *[F.max(c).alias(c) for c in keep])


def filtered_mean(df: DataFrame, y: str, where: Column, subset: list[str]) -> DataFrame:
    return df.filter(where).na.drop("any", subset=subset).agg(F.avg(y).alias("mean_y"))


def category_share(df: DataFrame, category: Column) -> DataFrame:
    """Rows per category and their percentage."""
    per = df.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("pct", 100.0 * F.col("n") / per.agg(F.sum("n")).scalar())


def mean_by(df: DataFrame, by: list[Column | str], y: str, name: str = "mean_y") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(y).alias(name))


def correlation(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Pearson correlation on complete pairs; null when either side is constant.

    The constant case is decided by min = max, as the division by zero would
    raise an error.
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(ok, F.col(x).cast("double")), F.when(ok, F.col(y).cast("double"))
    g = df.groupBy(*(by or [])).agg(
        F.covar_pop(px, py).alias("_c"),
        F.stddev_pop(px).alias("_sx"),
        F.stddev_pop(py).alias("_sy"),
        F.sum(ok.cast("long")).alias("n"),
        (F.min(px) == F.max(px)).alias("_kx"),
        (F.min(py) == F.max(py)).alias("_ky"),
    )
    r = F.when(F.col("_kx") | F.col("_ky"), F.lit(None).cast("double")).otherwise(
        F.try_divide(F.col("_c"), F.col("_sx") * F.col("_sy"))
    )
    return g.select(*(by or []), r.alias("cor"), "n")


def histogram(df: DataFrame, x: str, lo: float, hi: float, width: float) -> DataFrame:
    """Counts per bin (a, b]; the first bin also holds its left end. Empty bins stay.

    Bin 0 counts the values below lo, the bin after the last those above hi, so
    the counts add up to all values; their outer border is null. Nulls are in no bin.
    """
    n_bins = int(round((hi - lo) / width))
    v = F.col(x).cast("double")
    inner = F.greatest(F.lit(1), F.least(F.lit(n_bins), F.ceil((v - F.lit(lo)) / F.lit(width)).cast("int")))
    idx = F.when(v < lo, 0).when(v > hi, n_bins + 1).otherwise(inner)
    counts = df.filter(v.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(0, n_bins + 2).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(counts), "bin", "left").select(  # n_bins + 2 rows at most
        "bin",
        F.when(F.col("bin") > 0, F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("left"),
        F.when(F.col("bin") <= n_bins, F.lit(lo) + F.col("bin") * F.lit(width)).alias("right"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def sturges_breaks(lo: float, hi: float, n: int) -> tuple[float, float, float]:
    """Rounded (lo, hi, width) for about log2(n) + 1 bins.

    The width is 1, 2 or 5 times a power of ten, the one nearest to the wanted
    width on the scale used by the common "pretty" rule.
    """
    import math

    if hi <= lo:
        return lo - 0.5, lo + 0.5, 1.0
    raw = (hi - lo) / math.ceil(math.log2(n) + 1)
    base = 10.0 ** math.floor(math.log10(raw))
    width = base
    # pretty() with its default bias prefers the larger unit from these multiples on
    for unit, start in ((2.0, 1.4), (5.0, 2.8), (10.0, 7.0)):
        if raw > start * base:
            width = unit * base
    return math.floor(lo / width + 1e-7) * width, math.ceil(hi / width - 1e-7) * width, width


def histogram_auto(df: DataFrame, x: str) -> DataFrame:
    """Histogram with automatic breaks, which span all values; one small aggregate gives range and size."""
    v = F.col(x).cast("double")
    r = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).first()
    out = histogram(df, x, *sturges_breaks(r["lo"], r["hi"], r["n"]))
    return out.filter(F.col("left").isNotNull() & F.col("right").isNotNull())
