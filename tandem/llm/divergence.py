"""How the sources of each language differ in their words: an exact chi-square-like audit.

The counts of a language are a sparse matrix of groups (its sources) by terms.  Every pair
of its rows is compared by Gustavson's row accumulation: a group scatters its terms through
the term-major index of its peers into one dense accumulator of a value for each peer, so
no pair of postings is ever a row.  Terms that one of the two lacks, or both, have a small
constant share (a count of 0), which is added in closed form.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, setting, table

#: Terms: maximal runs of ASCII letters and all that is not ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents of a language that must hold a term.
MIN_DOCS = 10
#: Terms that a task gathers before it sends their counts.
GATHER = 150_000
#: Texts in an Arrow batch.
TEXT_ROWS = 100
#: Groups on a side of a tile of pairs, and postings of a block of terms, about.
TILE, BLOCK = 1024, 100_000
SCALE = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (binary), count, docs: occurrences and documents, summed over the table.

    Tasks add up what they can by themselves, so a word that is everywhere costs an entry a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())],
                    ["lang", "source", "term", "count", "docs"],
                )
            held.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = Counter(text.as_buffer().to_pybytes().translate(_FOLD).split())
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                df.update(words.keys())
            if sum(len(n) for n, _ in held.values()) >= GATHER:
                yield from flush()
        yield from flush()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    sent = rows.mapInArrow(count, "lang string, source string, term binary, count long, docs long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2v)), exact; null where v is 0."""
    above = (F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")).cast("decimal(38,0)")
    below = F.nullif((n + 2 * v).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.when(v > 0, F.call_function("div", above, below).cast("long") + 1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most SCALE + 1, so this fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _tile(key: tuple, t: pa.Table) -> pa.Table:
    """What the terms of one block add to the pairs of one tile.

    Rows with a null term name every group of the tile and its share at count 0 (``p``); the
    others are postings.
    """
    lang, left, right, _ = (k.as_py() for k in key)
    g, p = t.column("g").to_numpy(), t.column("p").to_numpy().astype(np.int64)
    term = t.column("term").combine_chunks().dictionary_encode()
    named = term.is_valid().to_numpy(zero_copy_only=False)
    code = term.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    groups = np.unique(g[~named])
    zero = np.ones(len(groups), np.int64)
    zero[np.searchsorted(groups, g[~named])] = p[~named]
    g, p, code = np.searchsorted(groups, g[named]), p[named], code[named]
    tile = groups // TILE
    peers = np.flatnonzero(tile == right)  # groups are in order, so each tile is a run of them
    first = int(peers[0]) if len(peers) else 0
    own = tile[g] == right
    order = np.argsort(code[own], kind="stable")
    col, share_, at = (g[own] - first)[order], p[own][order], code[own][order]
    start = np.searchsorted(at, np.arange(len(term.dictionary) + 1))  # the term-major index of the peers
    z = zero[peers]
    held = np.bincount(col, minlength=len(peers))
    same = np.unique(np.stack([col, share_]), axis=1, return_counts=True) if len(col) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    (same_col, same_p), same_n = same
    by_row = np.argsort(g, kind="stable")
    ends = np.searchsorted(g[by_row], np.arange(len(groups) + 1))
    out_g, out_h, out_v = [], [], []
    for row in np.flatnonzero(tile == left):
        mine = by_row[ends[row] : ends[row + 1]]
        pg, cg, zg = p[mine], code[mine], zero[row]
        acc = np.zeros(len(peers), np.int64)
        # both hold the term
        n = start[cg + 1] - start[cg]
        idx = np.repeat(start[cg] - np.cumsum(n) + n, n) + np.arange(n.sum())
        h, ph, pr = col[idx], share_[idx], np.repeat(pg, n)
        np.add.at(acc, h, _apart(pr, ph) - _apart(pr, z[h]) - _apart(zg, ph) + _apart(zg, z[h]))
        # the group holds it, whether or not the peer does; then the other way round
        for some, k in zip(*np.unique(pg, return_counts=True)):
            acc += k * _apart(some, z)
        np.add.at(acc, same_col, same_n * _apart(zg, same_p))
        acc -= (len(mine) + held) * _apart(zg, z)
        keep = np.flatnonzero(groups[peers] > groups[row])
        out_g.append(np.full(len(keep), groups[row], np.int64))
        out_h.append(groups[peers][keep])
        out_v.append(acc[keep])
    a = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (out_g, out_h, out_v)]
    return pa.table([pa.array([lang] * len(a[0]), pa.string()), *map(pa.array, a)], ["lang", "g", "h", "value"])


def _pairs(kept: DataFrame, groups: DataFrame, postings: int) -> DataFrame:
    """lang, g, h (g < h) and value of all pairs of groups of a language.

    Terms are dealt out in blocks and groups in tiles, so neither a language with most of the
    postings nor one with very many sources is one task's work.
    """
    blocks = max(1, math.ceil(postings / BLOCK))
    tiles = groups.groupBy("lang").agg((F.floor(F.max("g") / TILE) + 1).cast("int").alias("tiles"))
    rows = kept.select("lang", "term", "g", "p", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
    bare = groups.select("lang", F.lit(None).cast("binary").alias("term"), "g", F.col("zero").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = rows.unionByName(bare).join(tiles, "lang").withColumn("tile", F.floor(F.col("g") / TILE).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("lang", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "block", "term", "g", F.coalesce("p", F.lit(1).cast("long")).alias("p"))
    sums = dealt.groupBy("lang", "left", "right", "block").applyInArrow(_tile, "lang string, g long, h long, value long")
    return sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, top: int = 10, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources are from each other, and by which terms from their language.

    Part ``pair`` holds, for each source of a language, every other one; part ``term`` the
    ``top`` terms that the source uses more than its language.  Only terms in ``min_docs``
    documents of the language count.  Null lang, source and text are empty ones; a group
    without terms still has its pairs; a language without kept terms has pairs of value 0;
    repeated rows count each; an empty table gives no rows.  All sums are exact integers.
    """
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS):
        counts, counts_path = saved(term_counts(docs), "counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= min_docs)
    kept, kept_path = saved(counts.join(terms.select("lang", "term", "total"), ["lang", "term"]), "kept")
    langs = kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct().join(kept.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "lang_n")])
    groups = groups.withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    groups, groups_path = saved(groups.withColumn("zero", share(F.lit(0), F.col("n"), F.col("v"))), "groups")
    shared = kept.join(groups, ["lang", "source"]).select("lang", "source", "g", "term", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))

    name = lambda c: groups.select("lang", F.col("g").alias(c), F.col("source").alias(f"{c}_source"), F.col("zero").alias(f"{c}_zero"), *(["v"] if c == "g" else []))
    found = _pairs(shared, groups, kept.count()).join(name("g"), ["lang", "g"]).join(name("h"), ["lang", "h"])
    # terms that neither holds have the value of two zeros: added for all terms here, taken off in _tile for those held
    value = F.when(F.col("v") > 0, F.col("value") + F.col("v") * apart(F.col("g_zero"), F.col("h_zero"))).otherwise(F.lit(0).cast("long"))
    both = found.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("g_source").alias("source"), F.col("h_source").alias("item")), F.struct(F.col("h_source").alias("source"), F.col("g_source").alias("item")))).alias("x"))
    order = lambda *c: Window.partitionBy("lang", "source").orderBy(F.desc("value"), *c)
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order("item")))

    more = shared.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    best = more.withColumn("rank", F.row_number().over(order("item"))).where(F.col("rank") <= top)
    out = saved(pairs.unionByName(best), "divergence")[0]
    discard(docs.sparkSession, counts_path, kept_path, groups_path)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS words FROM documents
), t AS (SELECT doc, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS n FROM kept GROUP BY lang),
g AS (SELECT lang, source, (SELECT coalesce(sum(c.n), 0) FROM c WHERE c.lang = x.lang AND c.source = x.source) AS n FROM (SELECT DISTINCT lang, source FROM d) x),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p, 1 + (1000000000 * (k.total + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
