"""Profiles of values, sparsity, totals and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import order_statistics


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Values and counts, most frequent first, ties by value."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def value_profile(df: DataFrame, col: str, n_total: int | None = None) -> DataFrame:
    """min, max, mean; with ``n_total`` the rows that are missing from it count as zeros."""
    if n_total is None:
        return df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"))
    zeros = F.when(F.count(col) < n_total, F.lit(0.0))
    return df.agg(F.least(F.min(col), zeros).alias("min"), F.greatest(F.max(col), zeros).alias("max"), (F.coalesce(F.sum(col), F.lit(0.0)) / n_total).alias("mean"))


def sparsity_profile(df: DataFrame, col: str, n_total: int, approximate: bool = False) -> DataFrame:
    """Exact median and the percentage of zeros, absent rows counted as zeros.

    The median is selected by passes over the values (order_statistics), each of which counts
    them in a fixed number of bins, so neither distinct values nor ties cost memory.
    ``approximate`` takes it from a sketch of the values on its side of zero instead: one
    pass counts the signs, a second sketches.
    """
    if approximate:
        some = df.agg(F.count_if(F.col(col) < 0).alias("below"), F.count_if(F.col(col) > 0).alias("above")).first()
        below, above = some["below"], some["above"]
        zeros, half = n_total - below - above, n_total / 2
        pct = F.lit(100.0 * zeros / n_total).alias("pct_zeros")
        if below <= half <= below + zeros:
            return df.sparkSession.range(1).select(F.lit(0.0).alias("median"), pct)
        side, share = (F.col(col) < 0, half / below) if half < below else (F.col(col) > 0, (half - below - zeros) / above)
        return df.where(side).agg(F.percentile_approx(F.col(col).cast("double"), F.lit(share)).alias("median")).select("median", pct)
    (median,), some = order_statistics(df.where(F.col(col) != 0), col, shares=[0.5], n_total=n_total)
    return df.sparkSession.range(1).select(F.lit(median).cast("double").alias("median"), F.lit(100.0 * (n_total - some) / n_total if n_total else None).cast("double").alias("pct_zeros"))


def skew_corrected(df: DataFrame, col: str, n_total: int | None = None) -> DataFrame:
    """Bias-corrected skewness; null under three rows or if constant.

    With ``n_total`` the rows that are missing from it count as zeros: the central moments of the
    values and those of the zeros are merged in closed form, so nothing is made dense.
    """
    v = F.col(col)
    some, mean = F.count(v).cast("double"), F.coalesce(F.avg(v), F.lit(0.0))
    n = some if n_total is None else F.lit(float(n_total))
    zeros = n - some
    own2 = F.coalesce(F.var_pop(v) * some, F.lit(0.0))
    own3 = F.coalesce(F.skewness(v), F.lit(0.0)) * F.pow(own2, F.lit(1.5)) / F.sqrt(F.greatest(some, F.lit(1.0)))
    m2 = own2 + F.try_divide(mean * mean * zeros * some, n)
    m3 = own3 + F.try_divide(F.pow(mean, F.lit(3.0)) * zeros * some * (zeros - some), n * n) + F.try_divide(3 * mean * zeros * own2, n)
    g = F.try_divide(F.sqrt(n) * m3, F.pow(m2, F.lit(1.5)))
    return df.agg(F.when(n > 2, F.try_divide(g * F.sqrt(n * (n - 1)), n - 2)).alias("skew"))


def totals_per_cell(meas: DataFrame, cells: DataFrame, value: str = "value", name: str = "total") -> DataFrame:
    """Sum of values per cell, zero for cells without any."""
    sums = meas.groupBy("cell_id").agg(F.sum(value).alias(name))
    return cells.select("cell_id").join(sums, "cell_id", "left").select("cell_id", F.coalesce(name, F.lit(0.0)).alias(name))


def zero_fraction_per_cell(meas: DataFrame, cells: DataFrame, n_features: int, value: str = "value") -> DataFrame:
    """1 - share of features with a value other than zero."""
    some = meas.where(F.col(value) != 0).groupBy("cell_id").agg(F.count("*").alias("k"))
    return cells.select("cell_id").join(some, "cell_id", "left").select("cell_id", (1 - F.coalesce("k", F.lit(0)) / F.lit(float(n_features))).alias("zero_fraction"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """bin, lo, hi, n for ``bins`` equal widths, the last edge included, empty bins too.

    A constant column gets a range of +-0.5 around its value.  Nulls are not counted.
    """
    v = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")).where(F.col("lo").isNotNull())
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = v.crossJoin(F.broadcast(ends)).groupBy(place.alias("at")).agg(F.count("*").alias("n"))
    every = ends.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, F.col("bin") == F.col("at"), "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n")
    )
