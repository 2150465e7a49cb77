"""Joins: label resolution, pair alignment, overlaps and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import setting


def resolve_labels(labels: DataFrame, lookup: DataFrame, targets: DataFrame) -> DataFrame:
    """label, feature (null if unmatched) and how (direct, lookup or unmatched).

    A label that is itself a target wins over the lookup; a lookup entry counts only
    if its key is not null and is a target.
    """
    names = targets.select(F.col("feature").alias("target")).distinct()
    entries = lookup.where(F.col("gene").isNotNull()).join(names, F.col("gene") == F.col("target"), "left_semi").select(F.col("label").alias("entry"), "gene")
    return (
        labels.select("label").join(names, F.col("label") == F.col("target"), "left").join(entries, F.col("label") == F.col("entry"), "left")
        .select(
            "label", F.coalesce("target", "gene").alias("feature"),
            F.when(F.col("target").isNotNull(), "direct").when(F.col("gene").isNotNull(), "lookup").otherwise("unmatched").alias("how"),
        )
    )


def common_features(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("feature").intersect(b.select("feature"))


def _renamed(long: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    names = pairs.select(F.col(f"{side}_feature").alias("feature"), "pair_id")
    return long.join(names, "feature").select("cell_id", "pair_id", F.col("value").cast("double").alias(side))


def align_pairs(x_long: DataFrame, y_long: DataFrame, pairs: DataFrame, strict: bool = False) -> DataFrame:
    """x and y side by side: cell_id, pair_id, feature, x, y.

    Both inputs hold (cell_id, feature, value), non-zero rows only, so the full outer
    join is already the union of the non-zeros.  ``pairs`` holds pair_id, feature,
    x_feature and y_feature, one row for each pair.  A (cell, feature) that an input repeats
    would meet the other side more than once: ``strict`` counts these first and raises ValueError.
    """
    if strict:
        for side, long in (("x", x_long), ("y", y_long)):
            again = long.groupBy("cell_id", "feature").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).first()
            if again["keys"]:
                raise ValueError(f"{again['keys']} keys (cell_id, feature) stand in {again['rows']} rows of {side}")
    both = _renamed(x_long, pairs, "x").join(_renamed(y_long, pairs, "y"), ["cell_id", "pair_id"], "full")
    both = both.select("cell_id", "pair_id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    return both.join(pairs.select("pair_id", "feature"), "pair_id").select("cell_id", "pair_id", "feature", "x", "y")


def align_bucketed(x_long: DataFrame, y_long: DataFrame, pairs: DataFrame, name: str, buckets: int) -> DataFrame:
    """align_pairs() of two tables that are bucketed by cell_id, as a table ``name`` in the same buckets.

    A cell is in one bucket, so the join on (cell_id, pair_id) needs no shuffle: that is what the
    setting says while the table is written.  What later joins on cell_id needs none either.
    """
    with setting(x_long.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        align_pairs(x_long, y_long, pairs).write.mode("overwrite").bucketBy(buckets, "cell_id").sortBy("cell_id").saveAsTable(name)
    return x_long.sparkSession.table(name)


def attach_cells(pairs: DataFrame, cells: DataFrame, cols: list[str]) -> DataFrame:
    return pairs.join(cells.select("cell_id", *cols), "cell_id")


def unmatched(labels: DataFrame, resolved: DataFrame) -> DataFrame:
    """Labels without a match, in order."""
    matched = resolved.where(F.col("feature").isNotNull()).select("label")
    return labels.select("label").join(matched, "label", "left_anti").orderBy("label")


def match_coverage(labels: DataFrame, resolved: DataFrame) -> DataFrame:
    """total, matched, unmatched."""
    joined = labels.select("label").join(resolved.select("label", "feature"), "label", "left")
    hit = F.count("feature")
    return joined.agg(F.count("*").alias("total"), hit.alias("matched"), (F.count("*") - hit).alias("unmatched"))


def id_overlap(a: DataFrame, b: DataFrame, col: str = "cell_id") -> DataFrame:
    """n_common: ids in both tables."""
    return a.select(col).intersect(b.select(col)).agg(F.count("*").alias("n_common"))


def ids_identical(a: DataFrame, b: DataFrame, ord_col: str, col: str = "cell_id", strict: bool = False) -> DataFrame:
    """identical: the same ids at the same positions; ``strict`` runs it and raises ValueError if they are not."""
    left = a.select(F.col(ord_col).alias("o1"), F.col(col).alias("id1"))
    right = b.select(F.col(ord_col).alias("o2"), F.col(col).alias("id2"))
    same = F.col("o1").eqNullSafe(F.col("o2")) & F.col("id1").eqNullSafe(F.col("id2"))
    both = left.join(right, F.col("o1") == F.col("o2"), "full")
    out = both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("identical"), F.count_if(~same).alias("n_other"))
    if strict and not (found := out.first())["identical"]:
        raise ValueError(f"ids differ at {found['n_other']} positions")
    return out.select("identical")


def assert_aligned(x: DataFrame, y: DataFrame, keys: tuple[str, ...] = ("cell_id", "feature"), strict: bool = False) -> DataFrame:
    """n_x, n_y (distinct keys), only_x, only_y and aligned; ``strict`` runs it and raises ValueError if they are not."""
    k = list(keys)
    a, b = x.select(*k).distinct().withColumn("in_x", F.lit(1)), y.select(*k).distinct().withColumn("in_y", F.lit(1))
    out = a.join(b, k, "full").agg(
        F.count("in_x").alias("n_x"), F.count("in_y").alias("n_y"),
        F.count(F.when(F.col("in_y").isNull(), 1)).alias("only_x"), F.count(F.when(F.col("in_x").isNull(), 1)).alias("only_y"),
    )
    out = out.withColumn("aligned", (F.col("only_x") == 0) & (F.col("only_y") == 0))
    if strict and not (found := out.first())["aligned"]:
        raise ValueError(f"not aligned: {found['only_x']} of {found['n_x']} keys only in x, {found['only_y']} of {found['n_y']} only in y")
    return out


def compare_axes(c1: DataFrame, c2: DataFrame) -> DataFrame:
    """feature, r1, r2 of the features that both tables hold."""
    return c1.select("feature", F.col("pearson_r").alias("r1")).join(c2.select("feature", F.col("pearson_r").alias("r2")), "feature")


def axis_overlap(c1: DataFrame, c2: DataFrame) -> DataFrame:
    """n_first, n_second, n_both; zeros if nothing is shared."""
    a = c1.select("feature").distinct().withColumn("in_1", F.lit(1))
    b = c2.select("feature").distinct().withColumn("in_2", F.lit(1))
    return a.join(b, "feature", "full").agg(F.count("in_1").alias("n_first"), F.count("in_2").alias("n_second"), F.count(F.col("in_1") + F.col("in_2")).alias("n_both"))
