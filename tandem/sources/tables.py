"""Scans and sinks: annotation, measurement, lookup and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..operators.project import to_wide


#: Columns that the canonical tables have at least, with their types.
CELLS = StructType([StructField(c, StringType()) for c in ("cell_id", "cell_type", "donor_id")])
FEATURES = StructType([StructField(c, StringType()) for c in ("feature", "feature_type")])
MEASUREMENTS = StructType([*(StructField(c, StringType()) for c in ("cell_id", "feature_type", "feature", "layer")), StructField("value", DoubleType())])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema``, cast to its types, then any others; ValueError if some are missing."""
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"the table lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], *[c for c in df.columns if c not in schema.names])


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """One row per entity: CELLS and whatever else the table has."""
    return conform(spark.read.parquet(path), CELLS)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: FEATURES and whatever else the table has."""
    return conform(spark.read.parquet(path), FEATURES)


def read_measurements(spark: SparkSession, path: str, layer: str = "X") -> DataFrame:
    """Non-zero values of one layer; the filter reaches the scan (or prunes partitions)."""
    return conform(spark.read.parquet(path), MEASUREMENTS).where(F.col("layer") == layer).drop("layer")


def explode_matrix(df: DataFrame, id_col: str, vec_col: str, names: DataFrame) -> DataFrame:
    """(id, feature, value) of a vector column; ``names`` holds pos and feature."""
    return df.select(id_col, F.posexplode(vec_col).alias("pos", "value")).join(names, "pos").select(id_col, "feature", F.col("value").cast("double").alias("value"))


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table in CSV with a header."""
    return spark.read.schema(schema).csv(path, header=True)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """label, gene; an empty gene stays null, an entry that is ambiguous on purpose."""
    return spark.read.schema("label string, gene string").csv(path, header=True)


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A long result; Parquet for further work, CSV for exchange."""
    writer = df.write.mode("overwrite")
    writer.parquet(path) if fmt == "parquet" else writer.csv(path, header=True)


def write_wide(df: DataFrame, path: str, key: str = "pair_id", strata: list[str] | None = None) -> None:
    """A table of key x stratum, the key as first column."""
    wide = df if strata is None else to_wide(df, strata, key)
    wide.select(key, *[c for c in wide.columns if c != key]).write.mode("overwrite").csv(path, header=True)


def shape_summary(cells: DataFrame, features: DataFrame) -> DataFrame:
    """feature_type, n_cells, n_features."""
    return features.groupBy("feature_type").agg(F.count("*").alias("n_features")).crossJoin(F.broadcast(cells.agg(F.count("*").alias("n_cells"))))


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "cell_id") -> DataFrame:
    """A table of the catalog in so many buckets of ``key``, sorted by it, and a scan of it.

    Tables with the same number of buckets join on the key without a shuffle.  A task writes
    one bucket, so the rows are dealt out by the key once, here.
    """
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)
