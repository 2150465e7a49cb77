"""The driver's tables seen as paired measurements (and the same views as SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 32


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("cell_id"), F.concat(F.lit("T"), F.col("label")).alias("cell_type"), F.concat(F.lit("D"), F.col("vec_id") % 7).alias("donor_id")
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero values; the first 32 positions are GEX, the others ADT."""
    long = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("cell_id"), F.posexplode("embedding").alias("pos", "v"))
    return (
        long.select(
            "cell_id", F.when(F.col("pos") < WIDTH, "GEX").otherwise("ADT").alias("feature_type"),
            F.when(F.col("pos") < WIDTH, F.concat(F.lit("f"), F.col("pos"))).otherwise(F.concat(F.lit("p"), F.col("pos") - WIDTH)).alias("feature"),
            F.greatest(F.col("v").cast("double"), F.lit(0.0)).alias("value"),
        ).where(F.col("value") != 0)
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that occur, with their type."""
    return measurements(spark, sf_dir).select("feature", "feature_type").distinct()


def pair_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where(F.col("feature_type") == "ADT").select(
        F.col("feature").alias("pair_id"), F.concat(F.lit("f"), F.substring("feature", 2, 9)).alias("feature"),
        F.concat(F.lit("f"), F.substring("feature", 2, 9)).alias("x_feature"), F.col("feature").alias("y_feature"),
    )


def lineitem_pairs(spark: SparkSession, sf_dir: str, x: str = "l_discount", y: str = "l_tax") -> DataFrame:
    """Pairs at bench scale; there is no cell key, so strata are columns."""
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("pair_id"), F.col("l_suppkey").cast("string").alias("feature"), F.col(x).alias("x"), F.col(y).alias("y"),
        F.concat("l_returnflag", "l_linestatus").alias("cell_type"), F.year("l_shipdate").cast("string").alias("donor_id"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).distinct()


#: Rows of the lookup: a match, one hidden by a direct match, an ambiguous and an absent one.
LOOKUP = (("view", "visit"), ("purchase", "order"), ("signup", None), ("error", "absent"), ("click", "order"))
TARGETS = ("click", "visit", "order")


def lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOOKUP, "label string, gene string")


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TARGETS], "feature string")


SQL = """
cells AS (SELECT CAST(vec_id AS VARCHAR) AS cell_id, 'T' || label AS cell_type, 'D' || (vec_id % 7) AS donor_id FROM embeddings),
long AS (SELECT cell_id, pos, greatest(CAST(embedding[pos + 1] AS DOUBLE), 0.0::DOUBLE) AS value
         FROM (SELECT CAST(vec_id AS VARCHAR) AS cell_id, embedding, unnest(range(0, 64)) AS pos FROM embeddings)),
meas AS (SELECT cell_id, CASE WHEN pos < 32 THEN 'GEX' ELSE 'ADT' END AS feature_type,
                CASE WHEN pos < 32 THEN 'f' || pos ELSE 'p' || (pos - 32) END AS feature, value FROM long WHERE value <> 0),
feats AS (SELECT DISTINCT feature, feature_type FROM meas),
pairs AS (SELECT x.cell_id, 'p' || x.pos AS pair_id, 'f' || x.pos AS feature, x.value AS x, y.value AS y
          FROM long x JOIN long y ON x.cell_id = y.cell_id AND y.pos = x.pos + 32 WHERE x.pos < 32 AND (x.value <> 0 OR y.value <> 0)),
lpairs AS (SELECT CAST(l_suppkey AS VARCHAR) AS pair_id, CAST(l_suppkey AS VARCHAR) AS feature, l_discount AS x, l_tax AS y, l_quantity AS x2, l_extendedprice AS y2,
                  l_returnflag || l_linestatus AS cell_type, CAST(year(l_shipdate) AS VARCHAR) AS donor_id FROM lineitem),
labels AS (SELECT DISTINCT event_type AS label FROM events),
lookup(label, gene) AS (VALUES ('view', 'visit'), ('purchase', 'order'), ('signup', NULL), ('error', 'absent'), ('click', 'order')),
targets(feature) AS (VALUES ('click'), ('visit'), ('order')),
resolved AS (SELECT l.label, coalesce(t.feature, k.gene) AS feature,
                    CASE WHEN t.feature IS NOT NULL THEN 'direct' WHEN k.gene IS NOT NULL THEN 'lookup' ELSE 'unmatched' END AS how
             FROM labels l LEFT JOIN targets t ON l.label = t.feature
             LEFT JOIN (SELECT * FROM lookup WHERE gene IN (SELECT feature FROM targets)) k ON l.label = k.label)
"""
