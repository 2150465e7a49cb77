"""Projections, filters and reshaping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative and absolute tolerance within which a value counts as an integer (fixed values).
RTOL, ATOL = 1e-5, 1e-8


def split_modality(meas: DataFrame, features: DataFrame, feature_type: str) -> DataFrame:
    """Measurements of the features of one type.

    A name may stand in several types (a protein and its gene), so the key is
    (feature_type, feature) wherever ``meas`` tells its type; without that column it is
    the name alone.
    """
    key = [c for c in ("feature_type", "feature") if c in meas.columns]
    keep = features.where(F.col("feature_type") == feature_type).select(*key)
    return meas.join(keep, key, "left_semi")


def select_features(meas: DataFrame, names: DataFrame) -> DataFrame:
    """Measurements of the named features."""
    return meas.join(names.select("feature"), "feature", "left_semi")


def filter_stratum(df: DataFrame, col: str, value: str) -> DataFrame:
    return df.where(F.col(col) == value)


def nonzero_mask(pairs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows in which either value is not zero; NaN is not zero."""
    return pairs.where((F.col(x) != 0) | (F.col(y) != 0))


#: Bytes of dense rows that a task makes at a time.
DENSE_BYTES = 16_000_000


def densify(long: DataFrame, cells: DataFrame, features: DataFrame, value: str = "value") -> DataFrame:
    """Every (cell, feature), absent ones 0: cell_id, feature and value.

    Only the values that are there are shuffled, to one row for each cell with its places and values;
    that row is spread over the places of all features where it stands.  Features are numbered by
    type and name wherever both tables tell the type.  A value that stands twice is kept once (the greatest).
    """
    key = [c for c in ("feature_type", "feature") if c in long.columns and c in features.columns]
    names = features.select(*key).distinct().withColumn("_pos", F.row_number().over(Window.orderBy(*key)) - 1)
    n = names.count()
    entry = F.struct("_pos", F.col(value).cast("double").alias("v"))
    rows = long.select("cell_id", *key, value).join(names, key).groupBy("cell_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    rows = cells.select("cell_id").join(rows, "cell_id", "left").select("cell_id", F.coalesce("e._pos", F.array().cast("array<int>")).alias("pos"), F.coalesce("e.v", F.array().cast("array<double>")).alias("v"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, DENSE_BYTES // (8 * max(1, n)))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                b = batch.slice(s, step)
                out = np.zeros((b.num_rows, n))
                at = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("pos")).to_numpy())
                out[at, b.column("pos").flatten().to_numpy()] = b.column("v").flatten().to_numpy(zero_copy_only=False)
                cell = b.column("cell_id").take(pa.array(np.repeat(np.arange(b.num_rows), n)))
                yield pa.RecordBatch.from_arrays([cell, pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)), pa.array(out.ravel())], ["cell_id", "_pos", value])

    kind = cells.schema["cell_id"].dataType.simpleString()
    return rows.mapInArrow(spread, f"cell_id {kind}, _pos int, `{value}` double").join(names.select("_pos", "feature"), "_pos").select("cell_id", "feature", value)


def transform_values(df: DataFrame, col: str, log1p: bool = True) -> DataFrame:
    return df.withColumn(col, F.log1p(col)) if log1p else df


def log1p_positive(df: DataFrame, col: str) -> DataFrame:
    """Positive values only, as log1p."""
    return df.where(F.col(col) > 0).withColumn(col, F.log1p(col))


def off_integer(col: str) -> Column:
    whole = F.rint(col)
    return F.abs(F.col(col) - whole) > ATOL + RTOL * F.abs(whole)


def value_flags(df: DataFrame, col: str) -> DataFrame:
    """any_negative and any_non_integer of a column."""
    return df.agg(F.bool_or(F.col(col) < 0).alias("any_negative"), F.bool_or(off_integer(col)).alias("any_non_integer"))


def profile_columns(df: DataFrame, candidates: list[str]) -> DataFrame:
    """(column, value, n) of the candidates that exist, in one pass."""
    have = [c for c in candidates if c in df.columns]
    if not have:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    strings = df.select(*[F.col(c).cast("string").alias(c) for c in have])
    return strings.unpivot([], have, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def project(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns of ``mapping`` (old: new), renamed."""
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def with_difference(df: DataFrame, a: str, b: str, name: str = "diff") -> DataFrame:
    return df.withColumn(name, F.col(a) - F.col(b))


def strip_suffix(df: DataFrame, col: str) -> DataFrame:
    """Labels without what follows the first - or _."""
    return df.withColumn(col, F.regexp_replace(col, "[-_].*$", ""))


def to_wide(coupling: DataFrame, strata: list[str], key: str = "pair_id", value: str = "pearson_r") -> DataFrame:
    """A row per key and a column per stratum; the list of strata saves the pass that would find them."""
    return coupling.groupBy(key).pivot("stratum", strata).agg(F.first(value))


def to_long(wide: DataFrame, key: str = "pair_id", value: str = "pearson_r") -> DataFrame:
    """The way back; strata that a key lacks stay as null."""
    return wide.unpivot([key], [c for c in wide.columns if c != key], "stratum", value)


def heatmap_cells(coupling: DataFrame, lo: float = -0.5, hi: float = 1.0) -> DataFrame:
    """pair_id, stratum and r clipped to what a heat map shows."""
    shown = F.when(F.col("pearson_r").isNotNull(), F.greatest(F.least("pearson_r", F.lit(hi)), F.lit(lo)))
    return coupling.select("pair_id", "stratum", shown.alias("shown"))
