"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of


#: Texts of more than this share of the bytes come after all others, the shortest first.
LONG_SHARE = 1 / 50


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; it only says which rows are held out."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int, max_bytes: int) -> list[tuple[str, int]]:
    """Texts and labels for fitting: at most ``rows`` of each label and ``max_bytes`` together.

    ``allowed`` says which doc_ids may be learned from.  Rows come in the order of a hash
    of the id, so the sample is the same in every run; only texts of more than LONG_SHARE of
    ``max_bytes`` come last, by length, so none of them keeps out rows that fit.  The first row
    of a label is taken even if its text alone passes the bound, so that no label that has rows
    stays without one.  Of a document with several labels the largest counts.  A row that is
    repeated (in id and text) is taken once, so the bounds hold however often it stands there.
    Only ids, lengths and hashes are ordered; texts of the chosen rows alone are read in full.
    """
    known = labels.where(F.col(label).isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).alias("y"))
    texts = docs.select("doc_id", text_of().alias("t")).withColumn("hash", F.xxhash64("t"))
    sizes = texts.select("doc_id", "hash", F.octet_length("t").alias("bytes"))
    chosen = []
    for y in (0, 1):
        own = sizes.join(known.where(F.col("y") == y), "doc_id").groupBy("doc_id", "hash").agg(F.first("bytes").alias("bytes")).withColumn("h", F.xxhash64("doc_id"))
        order = (F.greatest("bytes", F.lit(int(max_bytes * LONG_SHARE))), "h", "doc_id", "bytes", "hash")
        first = own.orderBy(*order).limit(rows)
        running = F.sum("bytes").over(Window.partitionBy(F.lit(y)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        chosen.append(first.withColumn("sum", running).where((F.col("sum") <= max_bytes // 2) | (F.col("sum") == F.col("bytes"))).select("doc_id", "hash", F.lit(y).alias("y")))
    ids = chosen[0].unionByName(chosen[1])
    got = texts.join(F.broadcast(ids), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).collect()  # bounded by rows and max_bytes
    got.sort(key=lambda r: (r["doc_id"], r["t"]))
    return [(r["t"], r["y"]) for r in got]
