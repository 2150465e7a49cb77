"""Ranked lexical search over a length-stratified index.

Documents are grouped by equal normaliser m (a step function of their length).  In such a
stratum the share of a term in a score depends on nothing but its count tf, so its postings
are kept as runs of equal tf, the largest first, and an impact is computed once for each tf.
The first run of each term also gives the largest score that a stratum can hold for an item;
strata are visited from the highest such bound down, and those below an item's tenth
score are not visited at all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, saved, scratch, setting, table, text_of

#: Terms: maximal runs of ASCII letters, digits and all that is not ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same as a table over UTF-8 bytes, for bytes.translate() and split().
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A stratum is stored in chunks of at most so many documents or (but for its last document) terms.
CHUNK_DOCS, CHUNK_TERMS = 4096, 100_000
#: Terms of the items of a block, about; items beyond it are searched in further blocks.
BLOCK_TERMS = 200_000
#: Chunks from which an item's first scores are taken, highest bounds first.
SEED_CHUNKS = 4
#: Strata that hold more than one in so many of all terms are cut into slices, each of that share.
HOT_SHARE = 1000
#: Texts in an Arrow batch: those of one stratum may all be long.
TEXT_ROWS = 100
#: Rows of the index in an Arrow batch.
INDEX_ROWS = 32
INDEX = "chunk long, m long, docs array<long>, terms array<binary>, n_runs array<int>, tfs array<int>, lens array<int>, places array<int>"


def folded(text: str = "text") -> Column:
    return F.translate(text_of(text), UPPER, LOWER)


@dataclass
class Index:
    """Where the chunks of the strata are, and what all scores share: N documents with a term, L terms."""

    spark: SparkSession
    path: str
    n_docs: int
    n_terms: int

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(self.path)


def _chunk(row: int, m: int, held: list[tuple[int | None, Counter]]) -> pa.RecordBatch:
    """Postings of documents of one stratum, by term, then tf from the largest, then place; its name is its first row's."""
    names: dict[bytes, int] = {}
    term = np.fromiter((names.setdefault(t, len(names)) for _, c in held for t in c), np.int32)
    tf = np.fromiter((n for _, c in held for n in c.values()), np.int32, len(term))
    place = np.repeat(np.arange(len(held), dtype=np.int32), [len(c) for _, c in held])
    order = np.lexsort((place, -tf, term))
    term, tf, place = term[order], tf[order], place[order]
    at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])
    n_runs = np.bincount(term[at], minlength=len(names))
    lists = [pa.array([np.asarray(x, np.int32)], pa.list_(pa.int32())) for x in (n_runs, tf[at], np.diff(np.r_[at, len(term)]), place)]
    return pa.RecordBatch.from_arrays([pa.array([row]), pa.array([m]), pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([list(names)], pa.list_(pa.binary())), *lists], ["chunk", "m", "docs", "terms", "n_runs", "tfs", "lens", "places"])


def _chunks(batches: Iterator[pa.RecordBatch], chunk_docs: int, chunk_terms: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, m, doc, text) in the order of m to rows of the index."""
    first, at, held, size = 0, 0, [], 0
    for b in batches:
        for row, m, doc, text in zip(*(b.column(c).to_pylist() for c in ("row", "m", "doc")), b.column("text")):
            if held and (m != at or len(held) >= chunk_docs or size >= chunk_terms):
                yield _chunk(first, at, held)
                held, size = [], 0
            words = Counter(text.as_buffer().to_pybytes().translate(_FOLD).split())
            first, at, size = first if held else row, m, size + len(words)
            held.append((doc, words))
    if held:
        yield _chunk(first, at, held)


def normaliser(n: Column, n_docs: int, n_terms: int) -> Column:
    """m of documents of n terms; in decimals, so that no product of counts overflows."""
    product = (n * 90).cast("decimal(19,0)") * F.lit(n_docs).cast("decimal(19,0)")
    return F.lit(10) + F.call_function("div", product, F.lit(max(1, n_terms)).cast("decimal(19,0)")).cast("long")


def _sizes(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text) with n, the number of terms, or only how many documents have each n; those without a term go."""
    found: Counter = Counter()
    for b in batches:
        n = np.fromiter((len(t.as_buffer().to_pybytes().translate(_FOLD).split()) for t in b.column("text")), np.int64, b.num_rows)
        if keep:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], ["doc", "text", "n"]).filter(pa.array(n > 0))
        else:
            found.update(n.tolist())
    if not keep:
        found.pop(0, None)
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["n", "docs"])


def build(docs: DataFrame, chunk_docs: int = CHUNK_DOCS, chunk_terms: int = CHUNK_TERMS) -> Index:
    """Index every document that has a term: doc_id (cast to long) and text, whole.

    A first pass counts the documents of each length.  A second deals texts out by m; a stratum of
    more than one in HOT_SHARE of all terms (documents of one length, copies) is cut into slices by
    row, so at most HOT_SHARE strata are listed and broadcast.  Tasks read a stratum in
    order and store it in chunks.  Null and empty texts have no term and no score.  Repeated rows are
    documents of their own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text_of().cast("binary").alias("text"))
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS):
        sizes, sizes_path = saved(rows.mapInArrow(lambda batches: _sizes(batches, False), "n long, docs long").groupBy("n").agg(F.sum("docs").alias("docs")), "sizes")
        found = sizes.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.col("n") * F.col("docs")), F.lit(0)).alias("terms")).first()
        m = normaliser(F.col("n"), found["docs"], found["terms"])
        share = math.ceil(found["terms"] / HOT_SHARE) or 1
        strata = sizes.groupBy(m.alias("of")).agg(F.ceil(F.sum(F.col("n") * F.col("docs")) / share).alias("slices")).where("slices > 1")
        texts = rows.mapInArrow(lambda batches: _sizes(batches, True), "doc long, text binary, n long").select(m.alias("m"), F.monotonically_increasing_id().alias("row"), "doc", "text")
        placed = texts.join(F.broadcast(strata), F.col("m") == F.col("of"), "left").withColumn("slice", F.pmod(F.xxhash64("row"), F.coalesce("slices", F.lit(1))))
        dealt = placed.repartition("m", "slice").sortWithinPartitions("m", "slice", "row").select("row", "m", "doc", "text")
        path = scratch(spark, "index")
        dealt.mapInArrow(lambda batches: _chunks(batches, chunk_docs, chunk_terms), INDEX).write.option("parquet.block.size", 16 << 20).parquet(path)
    discard(spark, sizes_path)
    return Index(spark, path, found["docs"], found["terms"])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its terms, once each; rows of one item_id are one item, null is an item too."""
    return items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(folded(), F.lit(TERM), F.lit(0)))).alias("term")).distinct()


@dataclass
class Block:
    """Items of one block as arrays: each item's terms by their place in ``terms``, their weights, and the least score of interest."""

    n_items: int
    terms: pa.Array
    off: np.ndarray
    of: np.ndarray
    weight: np.ndarray
    least: np.ndarray

    def known(self, b: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a chunk that items hold: their places there and here."""
        here = pc.index_in(b.column("terms")[i].values, value_set=self.terms)
        here = here.fill_null(-1).to_numpy(zero_copy_only=False)
        there = np.flatnonzero(here >= 0)
        return there, here[there]

    def bounds(self, term: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The largest score that a chunk can hold for each item, from each term's largest impact."""
        best = np.zeros(len(self.terms), np.int64)
        best[term] = self.weight[term] * most
        return np.add.reduceat(best[self.of], self.off[:-1])


def _ints(b: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return b.column(name)[i].values.to_numpy(zero_copy_only=False)


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """Of each run, computed once for each tf of the stratum."""
    each, at = np.unique(tf.astype(np.int64), return_inverse=True)
    return (1_000_000_000 * each // (1000 * each + 8 * m))[at]


def _runs(b: pa.RecordBatch, i: int, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the known terms: number of runs, where each run is among all runs, and its impact."""
    n = _ints(b, "n_runs", i)
    first, own = (np.cumsum(n) - n)[there], n[there]
    run = np.repeat(first - np.cumsum(own) + own, own) + np.arange(own.sum())
    return own, run, impacts(_ints(b, "tfs", i)[run], b.column("m")[i].as_py())


def _bounds(block: Block, b: pa.RecordBatch, i: int) -> np.ndarray:
    there, here = block.known(b, i)
    own, _, impact = _runs(b, i, there)
    return block.bounds(here, impact[np.cumsum(own) - own])


def _best(score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by doc (nulls, as the largest value, last)."""
    if len(score) > 4 * k:
        low = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= low)
        return keep[np.lexsort((doc[keep], -score[keep]))[:k]]
    return np.lexsort((doc, -score))[:k]


NO_ID = np.iinfo(np.int64).max


def _visit(block: Block, b: pa.RecordBatch, k: int, top: dict, least: np.ndarray) -> None:
    """Score the chunks of a batch, for each item from the highest bound down, and keep the k best."""
    seen = [block.known(b, i) for i in range(b.num_rows)]
    read = [_runs(b, i, there) for i, (there, _) in enumerate(seen)]
    bounds = np.vstack([block.bounds(here, impact[np.cumsum(own) - own]) for (_, here), (own, _, impact) in zip(seen, read)])
    postings: dict[int, tuple] = {}

    def opened(i: int) -> tuple:
        if i not in postings:
            (_, here), (own, run, impact) = seen[i], read[i]
            lens = _ints(b, "lens", i)
            first, n = (np.cumsum(lens) - lens)[run], lens[run]
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            value = np.repeat(np.repeat(block.weight[here], own) * impact, n)
            ends = np.cumsum(np.add.reduceat(n, np.cumsum(own) - own)) if len(own) else np.zeros(0, np.int64)
            slot = np.full(len(block.terms), -1, np.int64)
            slot[here] = np.arange(len(here))
            docs = b.column("docs")[i].values.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            postings[i] = _ints(b, "places", i)[at], value, np.r_[0, ends], slot, docs
        return postings[i]

    for item in range(block.n_items):
        mine = block.of[block.off[item] : block.off[item + 1]]
        for i in np.argsort(-bounds[:, item], kind="stable"):
            if bounds[i, item] <= 0 or bounds[i, item] < least[item]:
                break
            place, value, off, slot, docs = opened(int(i))
            have = slot[mine]
            have = have[have >= 0]
            score = np.zeros(len(docs), np.int64)
            for s in have:  # a document stands once among the postings of a term
                score[place[off[s] : off[s + 1]]] += value[off[s] : off[s + 1]]
            good = np.flatnonzero(score >= max(1, least[item]))
            if not len(good):
                continue
            old = top.get(item, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            score, doc = np.r_[old[0], score[good]], np.r_[old[1], docs[good]]
            keep = _best(score, doc, k)
            top[item] = score[keep], doc[keep]
            if len(keep) == k:
                least[item] = max(least[item], score[keep[-1]])


def _scores(chunks: DataFrame, block, k: int) -> DataFrame:
    """(item, doc, score): of each task the k best of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, top = block.value, {}
        least = own.least.copy()
        for b in batches:
            _visit(own, b, k, top, least)
        for item, (score, doc) in top.items():
            ids = pa.array(doc, mask=doc == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), item, np.int32)), ids, pa.array(score)], ["item", "doc", "score"])

    return chunks.mapInArrow(run, "item int, doc long, score long")


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _frequencies(index: Index, block: Block) -> np.ndarray:
    """Documents that hold each term of the block."""
    shared = index.spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own.terms), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                there, here = own.known(b, i)
                runs, n = _ints(b, "n_runs", i), np.r_[0, np.cumsum(_ints(b, "lens", i))]
                last = np.cumsum(runs)
                total[here] += n[last[there]] - n[(last - runs)[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "n"])

    out = np.zeros(len(block.terms), np.int64)
    for r in index.chunks().select("terms", "n_runs", "lens").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def _survey(index: Index, shared, n_items: int) -> DataFrame:
    """(item, bound, chunk): of each task the chunks with the highest bounds for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        bound, chunk = np.zeros((0, n_items), np.int64), np.zeros((0, n_items), np.int64)
        for b in batches:
            ids = b.column("chunk").to_numpy(zero_copy_only=False)
            bound = np.vstack([bound, *(_bounds(own, b, i)[None] for i in range(b.num_rows))])
            chunk = np.vstack([chunk, np.broadcast_to(ids[:, None], (len(ids), n_items))])
            first = np.argsort(-bound, axis=0, kind="stable")[:SEED_CHUNKS]
            bound, chunk = np.take_along_axis(bound, first, 0), np.take_along_axis(chunk, first, 0)
        at, item = np.nonzero(bound)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(bound[at, item]), pa.array(chunk[at, item])], ["item", "bound", "chunk"])

    return index.chunks().select("chunk", "m", "terms", "n_runs", "tfs").mapInArrow(run, "item int, bound long, chunk long")


def _seeds(index: Index, shared, n_items: int, k: int) -> np.ndarray:
    """For each item a score that k documents reach, found in its SEED_CHUNKS chunks of the highest bound; 0 if there are fewer."""
    best = Window.partitionBy("item").orderBy(F.desc("bound"), "chunk")
    first = _survey(index, shared, n_items).withColumn("place", F.row_number().over(best)).where(F.col("place") <= SEED_CHUNKS).select("chunk").distinct()
    out = np.zeros(n_items, np.int64)
    for r in _ranked(_scores(index.chunks().join(F.broadcast(first), "chunk", "left_semi"), shared, k), k).where(F.col("rank") == k).collect():
        out[r["item"]] = r["score"]
    return out


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 of each item.

    Equal scores stand in the order of doc_id, null last.  Items (item_id, text) are searched in
    blocks of about BLOCK_TERMS terms, each a broadcast of that size and four passes over
    columns of the index: document frequencies, bounds, the first chunks, and all others.  A
    task sends k rows an item at most, and only those that reach what the first chunks gave.
    Items without terms, null or empty, have no rows.
    """
    spark = index.spark
    wanted, path = saved(item_terms(items), "items")
    n_blocks = max(1, math.ceil(wanted.count() / BLOCK_TERMS))
    parts = []
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", INDEX_ROWS):
        for at in range(n_blocks):
            own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == at).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()
            if not own:
                continue
            ids = {t: i for i, t in enumerate(sorted({t for r in own for t in r["terms"]}))}
            off = np.r_[0, np.cumsum([len(r["terms"]) for r in own])]
            block = Block(len(own), pa.array([t.encode() for t in ids], pa.binary()), off, np.array([ids[t] for r in own for t in r["terms"]]), np.zeros(len(ids), np.int64), np.zeros(len(own), np.int64))
            df = _frequencies(index, block)
            block.weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
            block.least = _seeds(index, spark.sparkContext.broadcast(block), len(own), k)
            found = _ranked(_scores(index.chunks(), spark.sparkContext.broadcast(block), k), k)
            names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
            parts.append(saved(found.join(F.broadcast(names), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score"), "ranked")[0])
    discard(spark, path)
    if not parts:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)


def query(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item; the index is deleted when they are found."""
    index = build(table(spark, sf_dir, "documents"))
    out = search(index, table(spark, sf_dir, "benchmark"))
    discard(spark, index.path)
    return out


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS words FROM documents
), s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(words)) AS BIGINT) AS nt FROM d WHERE len(words) > 0),
m AS (SELECT rid, doc_id, 10 + (90 * len(words) * nd) // nt AS m FROM d, s WHERE len(words) > 0),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), s),
r AS (
  SELECT b.item_id, m.doc_id, m.rid, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score
  FROM b JOIN p USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
