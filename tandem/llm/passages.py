"""Substring dedup on words: documents meet at winnowed anchors, matches grow both ways, repeats go."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import discard, pack, stays, table, text_of
from .exchange import SHORT_BITS, Arrays, attach, bits_for, entries_of, load, meet, merged, passes

#: Words of a window and of the anchor inside it.
WINDOW, ANCHOR = 20, 10
#: Bytes of a word's hash that go along with an anchor, to grow a match by that word.
CELL = 5
#: Bytes of text that are hashed at a time.
CHUNK = 600_000
#: An anchor is crowded if it occurs more than CROWD times, which a task still compares at once, and
#: makes up more than one in CROWDED_KEYS of all occurrences; so there are at most CROWDED_KEYS such
#: anchors (8 bytes each).  Its windows are some ten times the bytes of its occurrences.
CROWD, CROWDED_KEYS = 100_000, 4_000_000
TOP = ~np.uint64(0)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, doc, rid and text.

    doc orders documents (null first); rid tells rows apart that share a doc_id and is 0
    where ids are unique.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), text_of().alias("text"))
    rows, ids = base.agg(F.count("*"), F.countDistinct("doc")).first()
    rid = F.lit(0).cast("long") if rows == ids else F.pmod(F.xxhash64("text"), F.lit(2**32))
    return base.select("doc_id", "doc", rid.alias("rid"), "text")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK bytes of the column text, a row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        off = pack(b.column(b.schema.get_field_index("text")))[1]
        s = 0
        while s < b.num_rows:
            e = max(s + 1, int(np.searchsorted(off, off[s] + CHUNK, "right")) - 1)
            yield b.slice(s, e - s)
            s = e


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def slide(x: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of each w consecutive values, by doubling."""
    f, span = (np.minimum if least else np.maximum), 1
    while span * 2 <= w:
        x, span = f(x[:-span], x[span:]), span * 2
    return f(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


class Seeds:
    """Winnowed anchors of packed token sequences.

    hash: of the run of ``anchor`` tokens at each place; low: the least hash inside each
    window; at: the anchors, places whose hash is the least of some window (all of them
    where hashes are equal); windows and places are numbered over all texts, and a window
    that would cross the end of its text is not valid.
    """

    def __init__(self, whole: np.ndarray, off: np.ndarray, window: int, anchor: int) -> None:
        self.off, self.width = off, window - anchor + 1
        n, total = np.diff(off), int(off[-1])
        self.of = np.repeat(np.arange(len(n)), n)
        left = off[self.of + 1] - np.arange(total)  # tokens from here to the end of the text
        self.valid = left >= window
        self.hash = np.full(total, TOP)
        self.hash[: len(whole)] = np.where(left[: len(whole)] >= anchor, whole, TOP)
        if not self.valid.any():
            self.low, self.at = np.full(total, TOP), np.zeros(0, np.int64)
            return
        self.low = slide(np.r_[self.hash, np.full(self.width - 1, TOP)], self.width)
        shown = np.where(self.valid, self.low, np.uint64(0))
        high = slide(np.r_[np.zeros(self.width - 1, np.uint64), shown], self.width, least=False)
        # a place is an anchor if it is the least of the window with the largest least around it
        self.at = np.flatnonzero((high == self.hash) & (left >= anchor) & (high > 0))

    def ordinals(self) -> np.ndarray:
        """Number of each anchor within its text."""
        of = self.of[self.at]
        return np.arange(len(of)) - np.searchsorted(of, of, "left")

    def marked(self, data: pa.Array) -> np.ndarray:
        """Places of anchors whose ordinals the replies (one for each text, or null) name."""
        mark = np.zeros(len(self.hash), bool)
        of = self.of[self.at]
        first = np.searchsorted(of, np.arange(len(self.off) - 1), "left")
        for i in np.flatnonzero(np.asarray(data.is_valid())):
            mark[self.at[first[i] + load([data[int(i)].as_py()])["ordinal"].astype(np.int64)]] = True
        return mark

    def owned(self, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows whose least hash is that of a marked anchor, and the first anchor with it."""
        if not len(self.at):
            return self.at, self.at
        shown = slide(np.r_[np.where(marked, self.hash, TOP), np.full(self.width - 1, TOP)], self.width)
        start = np.flatnonzero(self.valid & (shown == self.low) & (shown != TOP))
        at = np.searchsorted(self.at, start)
        while len(wrong := np.flatnonzero(self.hash[self.at[at]] != self.low[start])):
            at[wrong] += 1
        return start, self.at[at]


class Words:
    """The words of an array of texts as seeds and as what stands around them.

    room: tokens of all texts for each entry that a pass may write (an entry takes some 90 bytes of disk).
    """

    window, anchor, cell, room = WINDOW, ANCHOR, CELL, 12

    def __init__(self, text: pa.Array) -> None:
        self.tok, off = tokens.words(*pack(text))
        self.seeds = Seeds(tokens.runs(self.tok, self.anchor), off, self.window, self.anchor)

    def around(self, at: np.ndarray, step: int, n: np.ndarray) -> np.ndarray:
        """Cells of the n words from each place on, going by ``step``; zero beyond."""
        side = self.window - self.anchor
        cells = self.tok.view(np.uint8).reshape(-1, 8)[:, 8 - self.cell :]
        steps = np.arange(side)
        place = np.where(steps < n[:, None], at[:, None] + step * steps, 0)
        return np.where((steps < n[:, None])[:, :, None], cells[place], 0).astype(np.uint8).reshape(len(at), side * self.cell)

    def whole(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the window at each start, and another as bytes to compare."""
        other = tokens.runs(tokens.mix(self.tok ^ np.uint64(tokens.LENGTH)), self.window)[start]
        return tokens.runs(self.tok, self.window)[start], np.pad(np.ascontiguousarray(other).view(np.uint8).reshape(-1, 8), ((0, 0), (0, -8 % self.cell)))


def dense(x: np.ndarray) -> np.ndarray:
    """Numbers equal values alike, from 0."""
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def grown(group: np.ndarray, cells: np.ndarray, size: np.ndarray, cell: int = CELL) -> list[np.ndarray]:
    """Classes of entries that still match when 0, 1, 2, ... words next to their anchors are looked at.

    ``group`` tells anchors apart.  A match grows by one word at a time: entries that are
    in one class stay together if their next words agree.
    """
    now = dense(group)
    out = [now]
    for k in range(0, cells.shape[1], cell):
        wide = np.zeros((len(cells), 8), np.uint8)
        wide[:, :cell] = cells[:, k : k + cell]
        out.append(now := dense((now << np.uint64(8 * cell)) | wide.view("<u8")[:, 0]))
    return out


def later_than_first(group: np.ndarray, doc: np.ndarray, at: np.ndarray, within: bool) -> np.ndarray:
    """Entries that another of their group precedes: in a smaller document or, if ``within``, earlier in the same one."""
    order = np.lexsort((at, doc, group))
    head = np.r_[True, group[order][1:] != group[order][:-1]]
    of = np.cumsum(head) - 1
    d, a = doc[order], at[order]
    later = np.zeros(len(group), bool)
    later[order] = (d != d[head][of]) | ((a != a[head][of]) & within)
    return later


def intervals(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of true values in a boolean matrix."""
    edge = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


NONE = {"doc": np.zeros(0, np.int64), "rid": np.zeros(0, np.int64), "first": np.zeros(0, np.int64), "count": np.zeros(0, np.int64)}


def extended(part: Arrays, side: int, classes: Callable, within: bool) -> tuple[np.ndarray, Arrays]:
    """Which entries hold a first window, and replies (doc, rid, first, count of starts) for the repeats.

    Entries: key, doc, rid, at (place of the anchor), low and high (how far before the anchor
    the windows that it owns start), left (backwards) and right tokens.  ``classes(group,
    tokens, sizes)`` tells how far matches grow to one side.  A window that starts o tokens
    before the anchor is equal in two places if they match over o tokens to the left
    and over the rest of the window to the right.  Windows next to each other make up one repeat.
    """
    group = dense(part["key"])
    left, right = classes(group, part["left"], part["n_left"].astype(np.int64)), classes(group, part["right"], part["n_right"].astype(np.int64))
    doc, place, low, high = (part[k].astype(np.int64) for k in ("doc", "at", "low", "high"))
    gone, useful = np.zeros((len(doc), side + 1), bool), np.zeros(len(doc), bool)
    for o in range(side + 1):
        at = np.flatnonzero((low <= o) & (o <= high))
        if len(at):
            match = (left[o][at].astype(np.uint64) << np.uint64(32)) | right[side - o][at].astype(np.uint64)
            later = later_than_first(match, doc[at], place[at], within)
            gone[at[later], side - o] = True  # columns in the order of starts
            useful[at[~later]] = True
    row, first, last = intervals(gone)
    return useful, {"doc": part["doc"][row], "rid": part["rid"][row], "first": place[row] - side + first, "count": last - first + 1}


def settled(part: Arrays, last: bool, frequent: int, compare: Callable[[Arrays], tuple[np.ndarray, Arrays]]) -> tuple[Arrays, Arrays]:
    """One side of an exchange: entries whose key is there ``frequent`` times or more are compared; those that hold a first window go on."""
    _, which, count = np.unique(part["key"], return_inverse=True, return_counts=True)
    often = np.flatnonzero(count[which] >= (2 if last else frequent))
    if not len(often):
        return ({} if last else part), NONE
    useful, reply = compare({k: v[often] for k, v in part.items()})
    if last:
        return {}, reply
    keep = np.ones(len(which), bool)
    keep[often[~useful]] = False
    return {k: v[keep] for k, v in part.items()}, reply


def same_windows(part: Arrays, classes: Callable, within: bool) -> tuple[np.ndarray, Arrays]:
    """extended() for windows of crowded anchors: key of the whole window, first (its start), whole (its tokens)."""
    size = np.full(len(part["key"]), part["whole"].shape[1], np.int64)
    match = classes(dense(part["key"]), part["whole"], size)[-1]
    later = later_than_first(match, part["doc"].astype(np.int64), part["first"].astype(np.int64), within)
    return ~later, {"doc": part["doc"][later], "rid": part["rid"][later], "first": part["first"][later], "count": np.ones(int(later.sum()), np.int64)}


def repeated(limit: float):
    """Entries whose key is there twice or more are told so; one of each key goes on, with their count.

    Keys that occur more than ``limit`` times are noted, with their count.
    """

    def settle(part: Arrays, last: bool) -> tuple[Arrays, ...]:
        order = np.argsort(part["key"], kind="stable")
        part = {k: v[order] for k, v in part.items()}
        head = np.r_[True, part["key"][1:] != part["key"][:-1]]
        alone = head & np.r_[head[1:], True]
        told = {k: part[k][~alone] for k in ("doc", "rid", "ordinal")}
        count = np.add.reduceat(part["count"].astype(np.int64), np.flatnonzero(head)) if len(head) else np.zeros(0, np.int64)
        if not last:
            return {**{k: v[head] for k, v in part.items()}, "count": count}, told
        many = count > limit
        return ({}, told, {"key": part["key"][head][many], "count": count[many]}) if many.any() else ({}, told)

    return settle


def repeats(rows: DataFrame, cut_up: type, n_tokens: float, classes: Callable, within: bool, frequent: int, bucket: int) -> DataFrame:
    """Replies (doc, rid, data: first and count of starts) of windows that also start earlier.

    Seeds are anchors that occur twice or more.  Their occurrences meet by key, each with
    the tokens around it that its windows cover, and matches grow both ways (extended()).
    The occurrences of a crowded anchor would meet in one task, so there its windows
    themselves are the seeds; a task sends only one of equal ones.  What meets is cut by key
    into passes, so that what is on disk at a time keeps its proportion to the texts, however
    many hops there are and however much repeats; each pass cuts the texts up again.
    """
    rows = rows.select("doc", "rid", "text")
    side = cut_up.window - cut_up.anchor
    anchors = n_tokens * 2 / (side + 2)

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Arrays]]:
        for b in chunks(batches):
            s = cut_up(column(b, "text")).seeds
            of = s.of[s.at]
            yield "seed", {"key": s.hash[s.at], "doc": np.asarray(column(b, "doc"))[of], "rid": np.asarray(column(b, "rid"))[of], "ordinal": s.ordinals(), "count": np.ones(len(of), np.int64)}

    seeds, path = meet(rows, sow, {"seed": repeated(max(CROWD, anchors / CROWDED_KEYS))}, anchors, short=True)
    notes = [load([r["data"]]) for r in seeds.where("doc is null").select("data").toLocalIterator()]  # CROWDED_KEYS at most
    crowd = rows.sparkSession.sparkContext.broadcast(np.sort(np.concatenate([np.zeros(0, np.uint64), *(n["key"].astype(np.uint64) for n in notes)])))
    entries = entries_of(seeds) + sum(int(n["count"].sum()) for n in notes) * (side + 2) / 2  # an anchor owns so many windows
    n_passes = passes(entries, bucket, n_tokens / cut_up.room)
    lead = np.uint64(max(0, 64 - bits_for(anchors) - SHORT_BITS))

    def crowded(keys: np.ndarray) -> np.ndarray:
        k = crowd.value
        keys = keys >> lead << lead
        return k[np.minimum(np.searchsorted(k, keys), len(k) - 1)] == keys if len(k) else np.zeros(len(keys), bool)

    def grow(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[tuple[str, Arrays]]:
        for b in chunks(batches):
            text = cut_up(column(b, "text"))
            s, doc, rid = text.seeds, np.asarray(column(b, "doc")), np.asarray(column(b, "rid"))
            start, at = s.owned(s.marked(column(b, "data")))
            many = crowded(s.hash[at])
            if n_passes > 1:  # equal windows have the same hash where they start
                own = s.hash[np.where(many, start, at)] % np.uint64(n_passes) == turn
                start, at, many = start[own], at[own], many[own]
            if many.any():
                one = start[many]
                of, (key, whole) = s.of[one], text.whole(one)
                yield "window", {"key": key, "doc": doc[of], "rid": rid[of], "first": one - s.off[of], "whole": whole}
                start, at = start[~many], at[~many]
            if not len(at):
                continue
            head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            p, of = at[head], s.of[at[head]]
            high, low = p - start[head], p - start[np.r_[head[1:], len(at)] - 1]
            n_left, n_right = np.minimum(high, p - s.off[of]), np.minimum(side - low, s.off[of + 1] - p - cut_up.anchor)
            yield "anchor", {
                "key": s.hash[p], "doc": doc[of], "rid": rid[of], "at": p - s.off[of], "low": low.astype(np.uint8), "high": high.astype(np.uint8),
                "n_left": n_left.astype(np.uint8), "n_right": n_right.astype(np.uint8), "left": text.around(p - 1, -1, n_left), "right": text.around(p + cut_up.anchor, 1, n_right),
            }

    near = attach(rows, seeds.where("doc is not null")).where(F.col("data").isNotNull())
    settle = {
        "anchor": lambda part, last: settled(part, last, frequent, lambda x: extended(x, side, classes, within)),
        "window": lambda part, last: settled(part, last, 2, lambda x: same_windows(x, classes, within)),
    }
    found = []
    for turn in range(n_passes):
        replies, own = meet(near, partial(grow, turn=turn), settle, entries / n_passes, bucket=bucket)
        found.append(replies)
        stays(own)
    discard(rows.sparkSession, path)
    return merged(found)


def covered(data: pa.Scalar, n: int, window: int) -> np.ndarray:
    """Which of n tokens the windows of a reply (or none) cover."""
    gone = np.zeros(n + 1, np.int64)
    if data.is_valid and n:
        found = load([data.as_py()])
        at, end = found["first"].astype(np.int64), found["first"].astype(np.int64) + found["count"].astype(np.int64) - 1 + window
        np.add.at(gone, at[end <= n], 1)
        np.add.at(gone, end[end <= n], -1)
    return np.cumsum(gone)[:n] > 0


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept (the kept words joined by one space).

    A word goes if a window of WINDOW words covers it whose words also start earlier:
    in a document with a smaller doc_id, or at an earlier place of the same one.  n_spans
    counts the maximal repeats that go.  Rows that share a doc_id count as one document; a
    null doc_id comes first.  Texts with fewer words than a window lose none; null and empty
    texts have none; long ones are compared in full; an empty table gives an empty one.

    Words are compared by hashes: an anchor's by 64 bits, each word that a match grows by
    its own CELL bytes, windows of crowded anchors by 128 bits.
    """
    rows = numbered(docs)
    n_words = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] / 6
    found = repeats(rows, Words, n_words, grown, True, 2, 100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            buf, off = pack(column(b, "text"))
            start, end, woff = tokens.word_spans(buf, off)
            data = column(b, "data")
            counts, texts = [], []
            for i in range(b.num_rows):
                n = int(woff[i + 1] - woff[i])
                gone = covered(data[i], n, WINDOW)
                keep = np.flatnonzero(~gone) + woff[i]
                spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if n else 0
                counts.append((n, int(gone.sum()), spans))
                texts.append(b" ".join([buf[s:e].tobytes() for s, e in zip(start[keep], end[keep])]))
            cols = list(zip(*counts))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "n_spans", "kept"])

    return attach(rows, found).select("doc_id", "text", "data").mapInArrow(run, "doc_id long, n_words long, n_removed long, n_spans long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 18 AS BIGINT))) AS i FROM d WHERE len(w) >= 20)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
