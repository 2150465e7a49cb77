"""Exact order statistics of a column of any size, by radix selection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Leading bits of a value that a pass tells apart: 64 bits take five passes at most.
BITS = 13
_TOP = np.uint64(1 << 63)


def keys(v: np.ndarray) -> np.ndarray:
    """64 bits in the order of the values: negative ones inverted, -0.0 as 0.0, NaN last."""
    v = np.where(np.isnan(v), np.nan, v) + 0.0
    b = v.view(np.int64)
    return np.where(b < 0, ~b.view(np.uint64), b.view(np.uint64) | _TOP)


def value(key: int) -> float:
    """The inverse of keys()."""
    bits = key & ((1 << 63) - 1) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _pass(df: DataFrame, col: str, done: int, wide: int, prefixes: list[int]) -> list:
    """Of the values that start with a prefix of ``done`` bits: number, least and greatest key by prefix and the next bits."""
    known = np.array(prefixes, np.uint64)
    rest = np.uint64(64 - done - wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(known) << wide
        n, lo, hi = np.zeros(size, np.int64), np.full(size, 2**64 - 1, np.uint64), np.zeros(size, np.uint64)
        for b in batches:
            key = keys(b.column(0).to_numpy(zero_copy_only=False))
            at = np.zeros(len(key), np.int64)
            if done:
                head = key >> np.uint64(64 - done)
                at = np.minimum(np.searchsorted(known, head), len(known) - 1)
                own = known[at] == head
                key, at = key[own], at[own]
            at = (at << wide) | ((key >> rest) & np.uint64((1 << wide) - 1)).astype(np.int64)
            n += np.bincount(at, minlength=size)
            np.minimum.at(lo, at, key)
            np.maximum.at(hi, at, key)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), *(pa.array((x[some] ^ _TOP).view(np.int64)) for x in (lo, hi))], ["at", "n", "lo", "hi"])

    found = df.select(F.col(col).cast("double").alias("v")).where("v is not null").mapInArrow(run, "at long, n long, lo long, hi long")
    return found.groupBy("at").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # 2^BITS rows a prefix at most


def order_statistics(df: DataFrame, col: str, ranks: list[int] | None = None, shares: list[float] | None = None, n_total: int | None = None) -> tuple[list[float | None], int]:
    """Values at 0-based ``ranks``, or linearly interpolated at ``shares`` of the column, and the number of rows read.

    With ``n_total`` the rows that are missing from it count as zeros, and ``df`` should hold no
    zeros.  Each pass counts the values by their next BITS bits among those that start like a value
    sought, and stops where all of them are one value, so tasks and driver hold 2^BITS counters a rank
    whatever the number of distinct values.  Nulls are no values; NaN is the greatest.  Ranks beyond the
    values give None.  If ``df`` is dear to make, write or cache it: it is read once a pass.
    """
    zero, found, sought, total, n_zeros, done = int(keys(np.zeros(1))[0]), {}, None, 0, 0, 0
    prefixes: dict[int, list[tuple[int, int]]] = {0: []}
    while prefixes and done < 64:
        wide, names = min(BITS, 64 - done), sorted(prefixes)
        rows = _pass(df, col, done, wide, names)
        bins: dict[int, dict[int, list[int]]] = {p: {} for p in names}
        for r in rows:
            bins[names[r["at"] >> wide]][r["at"] & ((1 << wide) - 1)] = [r["n"], r["lo"] + (1 << 63), r["hi"] + (1 << 63)]
        if sought is None:
            total = sum(r["n"] for r in rows)
            n_all = total if n_total is None else n_total
            n_zeros = n_all - total
            if n_zeros < 0:
                raise ValueError(f"{total} values are more than n_total = {n_total}")
            sought = ranks if ranks is not None else sorted({f((n_all - 1) * s) for s in shares for f in (math.floor, math.ceil)}) if n_all else []
            prefixes[0] = [(k, k) for k in sought if 0 <= k < n_all]
        if n_zeros and (head := zero >> (64 - done) if done else 0) in bins:
            b = bins[head].setdefault((zero >> (64 - done - wide)) & ((1 << wide) - 1), [0, zero, zero])
            b[:] = [b[0] + n_zeros, min(b[1], zero), max(b[2], zero)]
        after: dict[int, list[tuple[int, int]]] = {}
        for p in names:
            for rank, left in prefixes[p]:
                for at in sorted(bins[p]):
                    n, lo, hi = bins[p][at]
                    if left < n:
                        if lo == hi:
                            found[rank] = value(lo)
                        else:
                            after.setdefault((p << wide) | at, []).append((rank, left))
                        break
                    left -= n
        prefixes, done = after, done + wide
    if ranks is not None:
        return [found.get(k) for k in ranks], total
    out: list[float | None] = []
    for s in shares or []:
        at = (n_all - 1) * s if n_all else None
        a, b = (found[math.floor(at)], found[math.ceil(at)]) if at is not None else (None, None)
        out.append(None if a is None else a if a == b or at == math.floor(at) else a + (b - a) * (at - math.floor(at)))
    return out, total


def quantiles(df: DataFrame, col: str, shares: list[float], n_total: int | None = None) -> DataFrame:
    """share, value: exact quantiles, interpolated as numpy does; null where the column is empty."""
    got, _ = order_statistics(df, col, shares=shares, n_total=n_total)
    return df.sparkSession.createDataFrame(list(zip(map(float, shares), got)), "share double, value double")
