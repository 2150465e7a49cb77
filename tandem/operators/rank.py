"""Ordered reports: rankings, top and bottom k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .project import with_difference


def rank_by_r(c: DataFrame) -> DataFrame:
    """Descending r, missing last."""
    return c.orderBy(F.desc_nulls_last("pearson_r"), "pair_id")


def top_k(df: DataFrame, k: int, by: list[str], tie: str = "pair_id") -> DataFrame:
    """The k rows highest in the columns of ``by``, in turn."""
    return df.orderBy(*[F.desc_nulls_last(c) for c in by], tie).limit(k)


def bottom_k(c: DataFrame, k: int) -> DataFrame:
    """The k lowest, missing ones included, shown in descending order."""
    return c.orderBy(F.asc_nulls_first("pearson_r"), F.desc("pair_id")).limit(k).orderBy(F.desc_nulls_last("pearson_r"), "pair_id")


def axis_specific(compared: DataFrame, k: int) -> DataFrame:
    """Features most coupled in one axis and not the other, k each way."""
    d = with_difference(compared, "r1", "r2")
    first = d.orderBy(F.desc_nulls_last("diff"), "feature").limit(k).withColumn("direction", F.lit("first"))
    second = d.orderBy(F.asc_nulls_last("diff"), "feature").limit(k).withColumn("direction", F.lit("second"))
    return first.unionByName(second)


def variability_extremes(v: DataFrame, k: int) -> DataFrame:
    """The k most and k least variable features."""
    most = v.orderBy(F.desc_nulls_last("variance"), "pair_id").limit(k).withColumn("end", F.lit("most"))
    least = v.orderBy(F.asc_nulls_last("variance"), "pair_id").limit(k).withColumn("end", F.lit("least"))
    return most.unionByName(least)


def first_n(df: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    return df.orderBy(*order_cols).limit(n)


def sorted_names(df: DataFrame, col: str = "feature") -> DataFrame:
    return df.select(col).orderBy(col)
