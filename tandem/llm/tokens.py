"""Vectorised hashing of words, characters and their runs over packed texts.

Bytes are hashed in blocks of eight, each mixed into what came before by a bijection, and
runs of tokens by joining the hashes of their halves, so there is no algebra between
positions that unlike inputs could share.  Equal hashes name equal runs but for chance
(2^-64 for two given runs).  Operators say in their docstrings what they compare beyond hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Odd multipliers, and what the length of a run is mixed in with (fixed values).
BYTE, TOKEN, LENGTH = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Runs of more bytes are hashed one by one with a cryptographic hash.
LONG_RUN = 2048
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: What a run starts with, by its length.
_START = mix(np.arange(LONG_RUN + 1, dtype=U) * U(LENGTH) + U(BYTE))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end."""
    start, size = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    if not len(size):
        return np.zeros(0, U)
    longest = int(size.max())
    h = _START[np.minimum(size, LONG_RUN) if longest > LONG_RUN else size]
    h = mix((h ^ (eight[start] & _LOW[np.minimum(size, 8) if longest > 8 else size])) * U(TOKEN))
    live = np.flatnonzero((size > 8) & (size <= LONG_RUN)) if longest > 8 else ()
    at, left = start[live] + 8 if len(live) else (), size[live] - 8 if len(live) else ()
    while len(live):
        h[live] = mix((h[live] ^ (eight[at] & _LOW[np.minimum(left, 8)])) * U(TOKEN))
        go = np.flatnonzero(left > 8)
        live, at, left = live[go], at[go] + 8, left[go] - 8
    for i in np.flatnonzero(size > LONG_RUN) if longest > LONG_RUN else ():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : start[i] + size[i]], digest_size=8).digest(), "little")
    return h


def run_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hashes() of many short spans of a small buffer; aligned reads are ten times as fast as others."""
    size = end - start
    if (longest := int(size.max(initial=0))) > LONG_RUN:
        return span_hashes(buf, start, end)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,)).copy()  # aligned, eight times the size
    h = _START[size]
    h ^= eight[start] & _LOW[np.minimum(size, 8) if longest > 8 else size]
    h *= U(TOKEN)
    h = mix(h)
    for done in range(8, longest, 8):
        live = np.flatnonzero(size > done)
        h[live] = mix((h[live] ^ (eight[start[live] + done] & _LOW[np.minimum(size[live] - done, 8)])) * U(TOKEN))
    return h


def runs_of_bytes(buf: np.ndarray, k: int) -> np.ndarray:
    """span_hashes() of all runs of k bytes, k at most LONG_RUN."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    h = _START[k]
    for done in range(0, k, 8):
        h = mix((h ^ (eight[done : done + n] & _LOW[min(k - done, 8)])) * U(TOKEN))
    return h


def long_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Another hash of the bytes from each start to its end, which may be far apart: blocks of eight, each mixed with its place, are added up."""
    start, size = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
    if not len(size):
        return np.zeros(0, U)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    blocks = np.maximum(1, -(-size // 8))
    to = np.cumsum(blocks)
    k = np.arange(to[-1]) - np.repeat(to - blocks, blocks)
    word = eight[np.repeat(start, blocks) + 8 * k]
    word[to - 1] &= _LOW[size - 8 * (blocks - 1)]
    word = mix(mix(word * U(TOKEN)) ^ mix((k.astype(U) + U(1)) * U(BYTE)))
    return mix(mix(np.add.reduceat(word, to - blocks)) ^ size.astype(U) * U(LENGTH))


def byte_runs(buf: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes, k a multiple of eight."""
    if len(buf) < k:
        return np.zeros(0, U)
    eight = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,))
    n, h = len(buf) - k + 1, U(k * LENGTH % 2**64)
    for j in range(0, k, 8):
        h = mix((h ^ eight[j : j + n]) * U(TOKEN))
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    return mix((a ^ U(LENGTH)) * U(BYTE) + mix(b ^ (a >> U(32))))


def runs(tok: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring tokens, by joining runs of half the length."""
    h, span = tok, 1
    while span * 2 <= k and span < len(tok):
        h, span = joined(h[:-span], h[span:]), span * 2
    if len(tok) < k:
        return np.zeros(0, U)
    return joined(h[: len(h) - (k - span)], h[k - span :]) if k > span else h


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs that are not ASCII white space), and offsets of words by text."""
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)  # where a run may not go on: at the start of each text
    edge[off] = True
    start = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | edge[:-1])) if len(buf) else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (np.r_[~word[1:], True] | edge[1:])) + 1 if len(buf) else np.zeros(0, np.int64)
    return start, end, np.searchsorted(start, off)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and offsets by text."""
    start, end, woff = word_spans(buf, off)
    return span_hashes(buf, start, end), woff


def chars(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each code point, and offsets by text."""
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    end = np.r_[start[1:], len(buf)] if len(start) else start
    return span_hashes(buf, start, end), np.searchsorted(start, off)


def shingles(tok: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k tokens, and offsets by text; a text of fewer tokens, but not none, is one run."""
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    goff = np.r_[0, np.cumsum(count)]
    of = np.repeat(np.arange(len(n)), count)
    start = np.arange(goff[-1]) + (off[:-1] - goff[:-1])[of]
    whole, short = runs(tok, k), np.flatnonzero((n < k) & (n > 0))
    g = whole[np.minimum(start, len(whole) - 1)] if len(whole) else np.zeros(len(start), U)
    if len(short):
        h = n[short].astype(U) * U(LENGTH)
        for j in range(k - 1):
            more = np.flatnonzero(n[short] > j)
            h[more] = joined(h[more], tok[off[:-1][short[more]] + j])
        g[goff[short]] = h
    return g, goff


def min_hashes(g: np.ndarray, goff: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """(texts x n) minima of n hash functions over each text's shingles; texts need one at least."""
    mult = np.random.default_rng(seed).integers(0, 2**31, n, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((n, len(goff) - 1), np.uint32)  # a row a function, so that minima are written in place
    g = (g >> U(32)).astype(np.uint32)
    step = 0
    while step < len(goff) - 1:  # some 128k shingles at a time, to stay in the cache
        last = max(step + 1, int(np.searchsorted(goff, goff[step] + 131072, "right")) - 1)
        part, at = g[goff[step] : goff[last]], goff[step:last] - goff[step]
        buf = np.empty_like(part)
        for i in range(n):
            np.multiply(part, mult[i], out=buf)
            np.minimum.reduceat(buf, at, out=out[i, step:last])
        step = last
    return out.T


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` hashes that find a pair at the threshold with at least the recall."""
    return int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))


def band_keys(mins: np.ndarray, rows: int) -> np.ndarray:
    """(texts x bands) one 64-bit key for each band."""
    bands = mins.shape[1] // rows
    key = np.zeros((len(mins), bands), U)
    for j in range(rows):
        key = mix(key ^ mins[:, j : bands * rows : rows]) * U(TOKEN)
    return mix(key + (np.arange(bands, dtype=U) + U(1)) * U(BYTE))
