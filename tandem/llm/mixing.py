"""Mixing sources to target weights: capped water-filling and a seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, text_of

#: Hex digits of the seeded order that name a slice of a source.
SLICE_DIGITS = 3


def size_in_words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Targets of sources (source, size, weight).

    ``share`` times the sum of sizes is dealt out by weight; no target passes
    ``max_epochs`` times its source's size and what that cuts off goes to the others by
    weight, until none is above.  In the order of cap / weight the capped sources come
    first, so one running sum finds the level all others fill up to.  The frame holds
    one row for each source.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    everything = Window.partitionBy()
    order = Window.orderBy(cap / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    found = (
        sources.withColumn("cap", cap)
        .withColumn("total", F.sum("size").over(everything))
        .withColumn("place", F.row_number().over(order))
        .withColumn("level", level)
    )
    found = found.withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything)["level"])
    return found.withColumn("target", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight"))))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """Words that a mix takes from each document.

    Returns doc_id, size, source, source_size, target, copies (whole repetitions) and
    taken, a row for each row of ``docs``.  Sources in the order of their code points, null
    last, get ``weights`` in turn.  Each document is taken floor(target / source size)
    times; the rest of the target is drawn in a seeded order of the source's
    documents, each a further whole time, the last one that fits only in part, so a
    source gives its target rounded down.

    The order is cut into slices by its leading digits: sums of slices and running sums
    inside each slice give the place of a document, so a source that holds most rows
    is still spread over thousands of groups.  Documents that are empty take nothing;
    a source of only such documents has target 0; repeated rows count each.  Of documents whose
    keys tie the smaller doc_id, then the smaller one, comes first.  Long texts count in
    full; an empty table gives an empty one.  The frame of sources is one partition, so
    it is meant for some thousands of them.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    rows = docs.select("doc_id", "source", size_in_words().alias("size"), key.alias("key"))
    rows = cut(rows.withColumn("slice", F.substring("key", 1, SLICE_DIGITS)))
    by_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ranked = by_slice.groupBy("source").agg(F.sum("slice_size").alias("size")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighted = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    targets = water_fill(weighted, share, max_epochs).select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target")
    ahead = by_slice.select(
        F.col("source").alias("of"), F.col("slice").alias("at"),
        F.coalesce(F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
    )
    placed = ahead.join(targets.withColumnRenamed("of", "of_"), F.col("of").eqNullSafe(F.col("of_")))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    copies = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - F.col("copies") * F.col("source_size"))
    return (
        rows.withColumn("inside", inside)
        .join(placed, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
        .withColumn("copies", copies)
        .withColumn("taken", (F.col("copies") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead") - F.col("inside")))).cast("long"))
        .select("doc_id", "size", "source", "source_size", "target", "copies", "taken")
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix-1') AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((rank - 1) % 3 + 1 AS INT)] AS weight, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, row_number() OVER o AS place,
         (CAST(total AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, rank)
), t AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, water * weight) END AS target
  FROM (SELECT *, (SELECT level FROM l WHERE level * weight <= cap ORDER BY place LIMIT 1) AS water FROM l)
), c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE CAST(floor(t.target / t.source_size) AS BIGINT) END AS copies,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(copies * size + greatest(0, least(size, floor(target - copies * source_size) - before)) AS BIGINT) AS taken
FROM c
"""
