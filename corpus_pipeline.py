"""Five stages that turn documents into a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next stage's docs; all but the last return the columns of documents,
n_chars being that of the text as it then stands.  Further columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import decontaminate, fuzzy_lines, mixing, near, ngram_join, quality
from tandem.llm.common import cut, discard, passing, row_key, saved, table, text_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7 go.

    It is fitted on the given tables, so that a stage run by itself decides as a whole run does.
    Null and empty texts have the score of no difference; repeated rows share a decision.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model, out="_score").where(F.col("_score") >= 0.7).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat another go; a document that so loses its last word goes too.

    Null and empty texts have no line and stay.  Of repeated rows none goes for the other's sake, as
    rows that are equal in doc_id and text share one decision.
    """
    out = fuzzy_lines.dedup(docs.select(*COLUMNS))
    empty = (F.col("n_removed") > 0) & ~F.col("kept").rlike(r"[^\x20\x09-\x0D]")
    kept = out.where(~empty).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
    return kept.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the least doc_id (null last).

    Of several texts with that id the one with the least hash stays, and of rows that are
    equal in id and text the one with the least other columns.  Rows without words stay.
    """
    found = cut(ngram_join.classes(docs).select("doc_id", "doc", "rid", "root"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc", "rid")
    first = found.where("root is not null").groupBy("root").agg(F.min(place).alias("first")).select("first.*")
    rows = found.where("root is not null").groupBy("doc", "rid").agg(F.count("*").alias("n"))
    blank = found.where("root is null").select("doc", "rid", F.lit(1).alias("n")).distinct()
    keep = cut(first.select("doc", "rid").join(rows, ["doc", "rid"]).unionByName(blank))

    def held(ids: DataFrame) -> DataFrame:
        ids = ids.select(F.col("doc").alias("_doc"), F.col("rid").alias("_rid"))
        own = docs.select(*COLUMNS, ngram_join.doc_key().alias("_doc"), F.xxhash64(text_of()).alias("_rid"))
        return own.join(F.broadcast(ids) if ids.count() <= near.BROADCAST_NODES else ids, ["_doc", "_rid"], "left_semi")

    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "lang", "source", "n_chars", "doc_id", "text")
    once = held(keep.where("n > 1")).groupBy("_doc", "_rid").agg(F.min(row).alias("row")).select("row.*")
    return held(keep.where("n = 1")).select(*COLUMNS).unionByName(once.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a run of ten words of a benchmark item (or a whole shorter one) go.

    Null and empty texts hold none and stay; repeated rows share a decision.
    """
    found = decontaminate.hits(docs.select(row_key("doc_id", "text").alias("key"), "text"), table(spark, sf_dir, "benchmark"))
    bad = cut(found.select("key").distinct())
    bad = F.broadcast(bad) if bad.count() <= decontaminate.BROADCAST_DOCS else bad
    return docs.join(bad, row_key("doc_id", "text") == bad["key"], "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: doc_id, size, source, source_size, target, copies, taken; documents of which it takes nothing go.

    Null and empty texts have size 0, so nothing is taken of them; repeated rows count each.
    """
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can express neither the trained classifier nor MinHash; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with passing(spark):  # what a stage has written for itself goes when its result is written
            docs, path = saved(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(spark, last)
        last = path
    return docs
