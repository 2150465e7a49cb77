"""Fuzzy line dedup: character-shingle MinHash, exact Jaccard, one line kept for each component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near, tokens
from .common import cut, pack, table, text_of
from .near import Shape, components, once, pick, star_edges, verified
from .passages import chunks, column

#: Characters of a shingle, and the similarity from which lines count as the same.
CHARS, THRESHOLD = 5, 0.8
#: Hashes in a band, and the share of pairs at the threshold that some band must find.
#: Six hashes, as with fewer unlike lines share so many bands that they chain into one giant group.
BAND_ROWS, RECALL = 6, 0.998
#: Lines (8 bytes each) that a task remembers so as not to hash them again.
SEEN = 1_000_000
#: Bytes of neighbouring lines that are cut into shingles at a time.
BLOCK = 65_536
#: Bytes of (document, line numbers) up to which the lines to fetch, and those to remove, are broadcast.
BROADCAST_BYTES = 32_000_000


def line_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and number (from 0, all \\n-separated lines counted) of lines with a word."""
    n = len(off) - 1
    brk = np.flatnonzero(buf == 10)
    start, end = np.sort(np.r_[off[:-1], brk + 1]), np.sort(np.r_[off[1:], brk])
    of = np.repeat(np.arange(n), np.searchsorted(brk, off[1:]) - np.searchsorted(brk, off[:-1]) + 1)
    number = np.arange(len(of)) - np.searchsorted(of, of, "left")
    some = end > start
    blank = np.flatnonzero(some)[tokens._SPACE[buf[start[some]]]]  # so far: most lines start with a word
    some[blank] = [not tokens._SPACE[buf[s:e]].all() for s, e in zip(start[blank], end[blank])]
    return start[some], end[some], of[some], number[some]


def line_nodes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names a line, of a byte at least, by 64 bits of hash of its bytes."""
    return tokens.long_hashes(buf, start, end).view(np.int64)


def line_shingles(buf: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k characters of each line, and offsets by line; lines of fewer characters are one run.

    Lines come in order of place.  They are taken some BLOCK bytes at a time, to stay in the cache.
    """
    parts, counts, s = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while s < len(start):
        e = max(s + 1, int(np.searchsorted(end, start[s] + BLOCK, "right")))
        g, count = _block_shingles(buf[start[s] : end[e - 1]], start[s:e] - start[s], end[s:e] - start[s], k)
        parts.append(g)
        counts.append(count)
        s = e
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def _block_shingles(buf: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k characters of neighbouring lines, and how many each has."""
    inner = (buf & 0xC0) == 0x80
    if inner.any():
        place = np.flatnonzero(~inner)
        first, last = np.searchsorted(place, start), np.searchsorted(place, end)
        place = np.r_[place, len(buf)]
        whole = tokens.run_hashes(buf, place[:-k], place[k:]) if len(place) > k else np.zeros(0, np.uint64)
    else:
        first, last, whole = start, end, tokens.runs_of_bytes(buf, k)
    n = last - first
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.cumsum(count)
    at = np.arange(to[-1]) + np.repeat(first - to + count, count)
    g = whole[np.minimum(at, len(whole) - 1)] if len(whole) else np.zeros(len(at), np.uint64)
    short = np.flatnonzero((n < k) & (n > 0))
    g[(to - count)[short]] = tokens.span_hashes(buf, start[short], end[short])
    return g, count


def numbered_rows(docs: DataFrame) -> DataFrame:
    """doc_id, doc, rid and text of each row; doc orders them (null first), rid tells rows with one doc_id apart."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text_of()).alias("rid"), text_of().alias("text"))


def lines_of(rows: DataFrame) -> DataFrame:
    """doc, rid, line and node of every line with a word, and whether it is the first such of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            buf, off = pack(column(b, "text"))
            start, end, of, number = line_spans(buf, off)
            doc, rid = (np.asarray(column(b, c))[of] for c in ("doc", "rid"))
            head = np.r_[True, of[1:] != of[:-1]][: len(of)]
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(rid), pa.array(number.astype(np.int32)), pa.array(line_nodes(buf, start, end)), pa.array(head)], ["doc", "rid", "line", "node", "head"])

    return rows.select("doc", "rid", "text").mapInArrow(run, "doc long, rid long, line int, node long, head boolean")


def banded(k: int, bands: int):
    """Nodes and band keys of the lines in batches of texts; of a line that a task has just seen only the first."""

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen = np.zeros(0, np.int64)
        for b in chunks(batches):
            buf, off = pack(column(b, "text"))
            start, end, _, _ = line_spans(buf, off)
            names = line_nodes(buf, start, end)
            node, first = np.unique(names, return_index=True)
            at = np.minimum(np.searchsorted(seen, node), max(0, len(seen) - 1))
            new = seen[at] != node if len(seen) else np.ones(len(node), bool)
            node, first = node[new], np.sort(first[new])
            seen = np.sort(np.concatenate([seen, node]), kind="stable") if len(seen) < SEEN else node  # two sorted runs are merged
            node, start, end = names[first], start[first], end[first]
            if len(node):
                yield node, tokens.band_keys(tokens.min_hashes(*line_shingles(buf, start, end, k), bands * BAND_ROWS), BAND_ROWS)

    return produce


def line_texts(rows: DataFrame) -> DataFrame:
    """node and raw text of the lines that ``lines`` names, by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            buf, off = pack(column(b, "text"))
            start, end, of, number = line_spans(buf, off)
            lines = column(b, "lines")  # (document, line) as one number; lines are fewer than bytes
            wanted = np.repeat(np.arange(b.num_rows), lines.value_lengths()) * (len(buf) + 2) + np.asarray(lines.flatten())
            asked = np.isin(of * (len(buf) + 2) + number, wanted)
            start, end = start[asked], end[asked]
            raw = pa.array([buf[s:e].tobytes() for s, e in zip(start, end)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(line_nodes(buf, start, end)), raw], ["node", "raw"])

    return rows.select("text", "lines").mapInArrow(run, "node long, raw binary")


def shingle(k: int):
    """Shingles of an array of single lines, and offsets."""

    def run(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, off = pack(raw)
        return line_shingles(buf, off[:-1], off[1:], k)

    return run


def removed_lines(rows: DataFrame, k: int = CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, rid, lines: their numbers) of the lines that are not the first of their component."""
    bands = tokens.bands_for(threshold, RECALL, BAND_ROWS)
    slim = cut(lines_of(rows))
    n_rows, n_texts = slim.where("head").agg(F.count("*"), F.count_distinct("doc", "rid")).first()
    edges = star_edges(rows.select("text"), banded(k, bands), slim.count() * bands)
    place = F.struct("doc", "rid", "line")
    copied = cut(slim.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))

    # the first place of a line lends its text
    def fetch(wanted: DataFrame) -> DataFrame:
        first = pick(slim, wanted, "node").groupBy("node").agg(F.min(place).alias("first"))
        at = cut(first.select("first.*").groupBy("doc", "rid").agg(F.collect_set("line").alias("lines")))
        held = at.agg(F.coalesce(F.sum(F.lit(40) + 8 * F.size("lines")), F.lit(0))).first()[0]
        return once(line_texts(rows.join(F.broadcast(at) if held <= BROADCAST_BYTES else at, ["doc", "rid"])), n_rows > n_texts)

    found = verified(edges, fetch, Shape(shingle(k), bands, BAND_ROWS), threshold, counts=False)
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    # of a line that has neither a copy nor a link nothing is asked
    named = cut(copied.join(roots, "node", "full_outer").select("node", F.coalesce("root", "node").alias("root")))
    hint = F.broadcast if named.count() <= near.BROADCAST_NODES else lambda df: df
    members = cut(slim.join(hint(named), "node").select("root", "doc", "rid", "line"))
    groups = cut(members.groupBy("root").agg(F.min(place).alias("kept")))
    gone = members.join(hint(groups), "root").where(place != F.col("kept"))

    return cut(gone.groupBy("doc", "rid").agg(F.sort_array(F.collect_set("line")).alias("lines")))


def dedup(docs: DataFrame, k: int = CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """Every column of ``docs``, and n_lines, n_removed, removed (line numbers) and kept (the text without them).

    Lines are what \\n separates; those without a word stay and take no part.  Two lines
    are linked if the Jaccard similarity of their sets of ``k`` characters is ``threshold`` or
    more (a shorter line is one shingle, so only its copies match); of the lines that links
    connect only the first, by doc_id (null first) and number, is kept, wherever the
    others stand.  Rows that are equal in doc_id and text share one decision.  Null and
    empty texts have no lines and keep an empty text; long texts and lines are compared whole; an
    empty table gives an empty one.  Columns of ``docs`` that are called
    as one of the four new ones raise ValueError, so nothing is overwritten.
    """
    if clash := sorted({"n_lines", "n_removed", "removed", "kept"} & set(docs.columns)):
        raise ValueError(f"the table already has {', '.join(clash)}")
    gone = removed_lines(numbered_rows(docs), k, threshold).select(F.struct("doc", "rid").alias("at"), "lines")
    own = docs.select(F.struct("*").alias("row"), F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text_of()).alias("rid")).alias("at"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    parts = F.split(text, "\n")
    left = F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("lines", i), x)), lambda x: x.isNotNull())
    removed = F.coalesce("lines", F.array().cast("array<int>"))
    held = gone.agg(F.coalesce(F.sum(F.lit(40) + 4 * F.size("lines")), F.lit(0))).first()[0]
    return own.join(F.broadcast(gone) if held <= BROADCAST_BYTES else gone, "at", "left").select(
        "row.*", F.size(parts).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"),
        F.when(F.col("lines").isNull(), text).otherwise(F.array_join(left, "\n")).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("kept", 256).alias("kept_sha256"))

