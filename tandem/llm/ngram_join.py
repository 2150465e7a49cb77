"""Similarity join of documents on word n-grams: MinHash bands find, full sets decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import cut, pack, table, text_of
from .near import Shape, components, once, pick, star_edges, verified
from .passages import chunks, column

WORDS, THRESHOLD = 5, 0.8
#: Hashes in a band, and the share of pairs at the threshold that some band must find.
BAND_ROWS, RECALL = 6, 0.9998


def _sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    return tokens.shingles(*tokens.words(*pack(text)), k)


def doc_key() -> Column:
    """The id as a number that is never null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc, rid and text of each row; doc is the id and never null, rid tells texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("doc"), F.xxhash64(text_of()).alias("rid"), text_of().alias("text"))


def _node(g: np.ndarray) -> int:
    """Names a set of shingles by 8 bytes of digest."""
    return int.from_bytes(hashlib.blake2b(np.unique(g).tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, doc, rid (see ``keyed``), node (null without words) and bands, a row for each row of ``docs``."""
    bands = tokens.bands_for(threshold, RECALL, BAND_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks([whole]):
                g, off = _sets(column(b, "text"), k)
                some = np.flatnonzero(np.diff(off))
                keys = tokens.band_keys(tokens.min_hashes(g, np.r_[off[some], off[-1]], bands * BAND_ROWS), BAND_ROWS)
                node, lists = [None] * b.num_rows, [None] * b.num_rows
                for row, i in enumerate(some):
                    node[i], lists[i] = _node(g[off[i] : off[i + 1]]), keys[row].view(np.int64)
                own = [column(b, c) for c in ("doc_id", "doc", "rid")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(node, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "doc", "rid", "node", "bands"])

    return keyed(docs).mapInArrow(run, "doc_id long, doc long, rid long, node long, bands array<long>")


def named_texts(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """node and raw text of documents with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks([whole]):
                g, off = _sets(column(b, "text"), k)
                some = np.flatnonzero(np.diff(off))
                node = [_node(g[off[i] : off[i + 1]]) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), column(b, "text").take(pa.array(some)).cast(pa.binary())], ["node", "raw"])

    return docs.select("text").mapInArrow(run, "node long, raw binary")


def similar(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, copy_of, class_id, n_copies, n_links of ``classes``, a row for each row of ``docs``."""
    return classes(docs, k, threshold).select("doc_id", "copy_of", "class_id", "n_copies", "n_links")


def classes(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, doc, rid (see ``keyed``), root, copy_of, class_id, n_copies, n_links, a row for each row of ``docs``.

    Documents with equal sets of k-word shingles are copies: copy_of is the least doc_id
    among them and n_copies their number.  n_links counts the other sets whose Jaccard
    similarity is ``threshold`` or more, class_id is the least doc_id of all that such links
    connect.  A document of fewer than k words has one shingle, all its words; one without
    words (null, empty, blank) is alone in its class, with no links.  root names the class, also
    where all its ids are null; it is null without words.  Texts are compared whole, however long; rows
    that are equal in id and text are copies of each other; of equal ids the ties do not matter, as only
    the least id is told; an empty table gives an empty one.
    """
    bands = tokens.bands_for(threshold, RECALL, BAND_ROWS)
    slim = cut(signatures(docs, k, threshold))
    known = slim.where(F.col("node").isNotNull())

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            if b.num_rows:
                yield np.asarray(b.column(0)), np.asarray(b.column(1).flatten()).view(np.uint64).reshape(b.num_rows, bands)

    rows, texts = known.agg(F.count("*"), F.count_distinct("doc", "rid")).first()
    edges = star_edges(known.select("node", "bands"), banded, rows * bands)

    # a row of each class of copies lends its text
    def fetch(nodes: DataFrame) -> DataFrame:
        wanted = pick(known.select("node", "doc", "rid"), nodes, "node").groupBy("node").agg(F.min(F.struct("doc", "rid")).alias("first"))
        return once(named_texts(pick(keyed(docs).select("doc", "rid", "text"), wanted.select("first.*"), ["doc", "rid"]), k), rows > texts)

    found = verified(edges, fetch, Shape(lambda raw: tokens.shingles(*tokens.words(*pack(raw)), k), bands, BAND_ROWS), threshold)
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    copies = known.groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"))
    named = copies.join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    named = named.join(least, "root").select("node", "root", "copy_of", "n_copies", "class_id", F.coalesce("links", F.lit(0)).alias("n_links"))
    return slim.select("doc_id", "doc", "rid", "node").join(named, "node", "left").select(
        "doc_id", "doc", "rid", "root", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
