"""Exchanges of packed arrays: equal keys meet, and what is found goes back to its document.

A task turns its rows into arrays (one entry for each place in a text), settles what it
can by itself, and sends the rest, packed into one row for each bucket of keys.  Of a key
that a task holds many times only one entry is sent, so a key that is everywhere costs
one entry a task.  Spark deals the buckets out; numpy sorts inside each.

A task sends to at most 2^HOP buckets at a time, so a message holds GATHER / 2^HOP entries or
more, however many buckets there are.  Where keys need more buckets they take several hops:
each deals out HOP further bits of the key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import mix

#: Entries that a bucket holds, about, and that a task gathers before it sends.
BUCKET, GATHER = 250_000, 250_000
#: Bits of a key that one hop deals out.
HOP = 12
#: Bits of a key that go along with its bucket where keys may be shortened.
SHORT_BITS = 40
Arrays = dict[str, np.ndarray]
PACKED = "bucket int, kind string, dest int, data binary"


def bits_for(entries: float, bucket: int = BUCKET) -> int:
    return max(0, math.ceil(math.log2(max(1.0, entries / bucket))))


def levels(bits: int, hop: int = HOP) -> list[int]:
    """Leading bits of the key that a bucket stands for after each hop."""
    n = max(1, math.ceil(bits / hop))
    return [math.ceil(bits * (k + 1) / n) for k in range(n)]


def narrow(a: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds non-negative values; signed ones beyond 32 bits stay as they are."""
    if a.dtype.kind not in "iu" or not len(a) or int(a.min()) < 0 or (a.dtype.kind == "i" and int(a.max()) >= 2**32):
        return a
    return a.astype(np.min_scalar_type(int(a.max())))


def dump(arrays: Arrays) -> bytes:
    """Arrays of any types as bytes: a line of names, types and widths, then their values as they are in memory."""
    cols = {k: narrow(a) if a.ndim == 1 else a for k, a in arrays.items()}
    n = len(next(iter(cols.values())))
    head = f"{n};" + ",".join(f"{k}:{a.dtype.str[1:]}{'' if a.ndim == 1 else f':{a.shape[1]}'}" for k, a in cols.items())
    return b"".join([head.encode(), b"\n", *(np.ascontiguousarray(a).astype(a.dtype.newbyteorder("<"), copy=False).tobytes() for a in cols.values())])


def load(blobs: list[bytes]) -> Arrays:
    """The inverse of dump(), joined up; a blob may be several that follow each other."""
    parts: dict[str, list[np.ndarray]] = {}
    for blob in blobs:
        at = 0
        while at < len(blob):
            line, at = at, blob.index(b"\n", at) + 1
            n, _, fields = blob[line : at - 1].decode().partition(";")
            for field in fields.split(","):
                name, kind, *width = field.split(":")
                size = int(n) * (int(width[0]) if width else 1)
                a = np.frombuffer(blob, np.dtype(f"<{kind}"), size, at)
                at += a.nbytes
                parts.setdefault(name, []).append(a.reshape(int(n), int(width[0])) if width else a)
    return {k: np.concatenate([x.astype(np.result_type(*v), copy=False) for x in v]) for k, v in parts.items()}


def spread(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def packed(kind: str, bucket: np.ndarray, arrays: Arrays) -> pa.RecordBatch:
    """One row for each bucket; for replies, which wait for the next exchange, dest is the bucket and any bucket will do."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    rows = [dump({k: a[order[s:e]] for k, a in arrays.items()}) for s, e in zip(at, np.r_[at[1:], len(bucket)])] if len(at) else []
    return messages(bucket[at], [kind] * len(rows), rows)


def messages(bucket, kinds: list[str], data: list[bytes], dest=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kinds, pa.string()), pa.array(bucket if dest is None else dest, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "dest", "data"])


def hops(sent: DataFrame, steps: list[int], kinds: list[str], key: Callable[[Arrays], np.ndarray], last: Callable[[Arrays], Arrays] = lambda a: a) -> DataFrame:
    """Messages of the given kinds, sent to buckets of ``steps[0]`` bits, in buckets of ``steps[-1]``.

    Each hop reads the messages of one bucket after the other, so what it sends is packed as well.
    ``key`` finds the keys of entries; ``last`` changes entries before they are sent for the last time.
    Messages of other kinds go to some bucket of the new number.
    """
    for now, after in zip(steps, steps[1:]):
        final = after == steps[-1]

        def run(batches: Iterator[pa.RecordBatch], after: int = after, final: bool = final) -> Iterator[pa.RecordBatch]:
            held: dict[str, list[bytes]] = {}
            size, at, turn = 0, None, 0

            def flush() -> Iterator[pa.RecordBatch]:
                for kind, blobs in held.items():
                    part = load(blobs)
                    where = spread(key(part), after)
                    yield packed(kind, where, last(part) if final else part)
                held.clear()

            for b in batches:
                for bucket, kind, dest, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "dest", "data"))):
                    if kind not in kinds:
                        turn += 1
                        yield messages([(dest * 2654435761 + turn) % 2**after], [kind], [data], [dest])
                        continue
                    if bucket != at or size >= GATHER:
                        yield from flush()
                        at, size = bucket, 0
                    held.setdefault(kind, []).append(data)
                    size += int(data[: data.index(b";")])
            yield from flush()

        sent = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PACKED)
    return sent


def doc_key(doc: np.ndarray, rid: np.ndarray) -> np.ndarray:
    return mix(mix(doc.astype(np.int64).view(np.uint64)) ^ rid.astype(np.uint64))


def gathered(batches: Iterator[tuple[str, Arrays]], gather: int = GATHER) -> Iterator[tuple[str, Arrays]]:
    """Arrays of one kind joined up to about ``gather`` entries."""
    held: dict[str, list[Arrays]] = {}
    join = lambda parts: {k: np.concatenate([h[k] for h in parts]) for k in parts[0]}
    for kind, b in batches:
        if len(b["key"]):
            held.setdefault(kind, []).append(b)
        if sum(len(h["key"]) for h in held.get(kind, [])) >= gather:
            yield kind, join(held.pop(kind))
    for kind, parts in held.items():
        yield kind, join(parts)


def meet(
    rows: DataFrame, produce: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[str, Arrays]]],
    settle: dict[str, Callable[[Arrays, bool], tuple[Arrays, ...]]], entries: float, bucket: int = BUCKET, short: bool = False,
) -> tuple[DataFrame, str]:
    """Run one exchange; returns (doc, rid, data: packed arrays) for each document with a reply, and where they are saved.

    ``produce`` gives a kind and arrays with ``key`` (uint64); keys of a kind meet only each
    other.  ``settle[kind](arrays, last)`` gives what must still meet others and replies with
    ``doc`` and ``rid``; it runs once in the task that made the entries and, with last, once for
    each bucket of keys.  With last it may give notes too, arrays that are no reply: they come
    back in rows whose doc and rid are null.  ``short`` keeps only the leading bits of keys,
    for uses in which a rare false match does no harm.
    """
    bits = bits_for(entries, bucket)
    steps = levels(bits)
    home = levels(max(0, bits - 3))  # replies go to fewer buckets, as each bucket of keys writes to all of them
    cut_off = np.uint64(max(0, 64 - bits - SHORT_BITS))

    def shorten(part: Arrays) -> Arrays:
        if not short:
            return part
        low = (part["key"] >> cut_off) & np.uint64(2**SHORT_BITS - 1)
        return {k: v for k, v in part.items() if k != "key"} | {"key_a": (low >> np.uint64(8)).astype(np.uint32), "key_b": (low & np.uint64(255)).astype(np.uint8)}

    def reply_to(reply: Arrays) -> pa.RecordBatch:
        return packed("reply", spread(doc_key(reply["doc"], reply["rid"]), home[0]), reply)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, part in gathered(produce(batches), min(GATHER, 2 * bucket)):  # small buckets are asked for where entries are large
            if short:
                part["key"] = part["key"] >> cut_off << cut_off
            rest, reply = settle[kind](part, False)
            if len(rest["key"]):
                yield packed(kind, spread(rest["key"], steps[0]), shorten(rest) if len(steps) == 1 else rest)
            if len(reply["doc"]):
                yield reply_to(reply)

    def answer(t: pa.Table) -> pa.Table:
        kinds, blobs, dest = (t.column(c).to_pylist() for c in ("kind", "data", "dest"))
        where, out = t.column("bucket")[0].as_py(), []
        for kind in settle:
            if asks := [b for k, b in zip(kinds, blobs) if k == kind]:
                part = load(asks)
                if short:
                    part["key"] = (np.uint64(where) << np.uint64(64 - bits) if bits else np.uint64(0)) | (((part.pop("key_a").astype(np.uint64) << np.uint64(8)) | part.pop("key_b").astype(np.uint64)) << cut_off)
                _, reply, *notes = settle[kind](part, True)
                if len(reply["doc"]):
                    out.append(reply_to(reply))
                out += [packed("note", np.zeros(len(next(iter(n.values()))), np.int32), n) for n in notes]
        same = [(d, b) for k, d, b in zip(kinds, dest, blobs) if k == "reply"]
        out.append(messages([d for d, _ in same], ["reply"] * len(same), [b for _, b in same]))
        return pa.Table.from_batches(out)

    def by_doc(t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("kind").to_pylist(), t.column("data").to_pylist()
        notes = [b for k, b in zip(kinds, blobs) if k == "note"]
        out = [pa.table([pa.array([None] * len(notes), pa.int64()), pa.array([None] * len(notes), pa.int64()), pa.array(notes, pa.binary())], ["doc", "rid", "data"])]
        if not (blobs := [b for k, b in zip(kinds, blobs) if k == "reply"]):
            return out[0]
        a = load(blobs)
        order = np.lexsort((a["rid"], a["doc"]))
        a = {k: v[order] for k, v in a.items()}
        at = np.flatnonzero(np.r_[True, (a["doc"][1:] != a["doc"][:-1]) | (a["rid"][1:] != a["rid"][:-1])])
        ends = np.r_[at[1:], len(a["doc"])]
        rest = [k for k in a if k not in ("doc", "rid")]
        out.append(pa.table([pa.array(a["doc"][at].astype(np.int64)), pa.array(a["rid"][at].astype(np.int64)), pa.array([dump({k: a[k][s:e] for k in rest}) for s, e in zip(at, ends)], pa.binary())], ["doc", "rid", "data"]))
        return pa.concat_tables(out)

    asked = hops(rows.mapInArrow(send, PACKED), steps, list(settle), lambda a: a["key"].astype(np.uint64), shorten)
    answered = hops(asked.groupBy("bucket").applyInArrow(answer, PACKED), home, ["reply"], lambda a: doc_key(a["doc"], a["rid"]))
    return saved(answered.groupBy("bucket").applyInArrow(by_doc, "doc long, rid long, data binary"), "replies")


def entries_of(replies: DataFrame) -> int:
    """How many entries the replies hold, by the number that each message begins with."""
    n = F.substring_index(F.substring("data", 1, 20).cast("string"), ";", 1).cast("long")
    return replies.where("doc is not null").agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]


def passes(entries: float, bucket: int, most: float) -> int:
    """Into how many passes, by key, entries are to be cut so that one pass writes no more than ``most`` of them.

    Each hop writes them again, and its files stay until the exchange is done.  Passes of a few
    buckets are not cut.
    """
    n = 1
    while entries / n * len(levels(bits_for(entries / n, bucket))) > max(most, 16 * BUCKET):
        n += 1
    return n


def merged(replies: list[DataFrame]) -> DataFrame:
    """The replies of several passes, one row for each document."""
    if len(replies) == 1:
        return replies[0]
    return reduce(DataFrame.unionAll, replies).groupBy("doc", "rid").agg(F.listagg("data").alias("data"))


def attach(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Rows with the data of their replies or null."""
    return rows.join(replies, ["doc", "rid"], "left")
