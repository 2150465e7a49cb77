"""Candidate links by band keys, exact Jaccard in tiles, and connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import tokens
from .common import cut, discard, saved, stays

#: Members of a candidate group that are compared in one task with as many others.
TILE = 128
#: Members of a group up to which it is compared in one pass with the other small groups of its unit.
FEW = 8
#: (key, node) pairs that a task of the band exchange holds, about.
BUCKET_PAIRS = 500_000
#: Nodes up to this many (8 bytes each) are broadcast to pick their texts; more are shuffled.
BROADCAST_NODES = 500_000
#: Bytes of the texts of groups' heads up to which they are broadcast.
BROADCAST_BYTES = 32_000_000
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, the least node of each, and edges from other nodes to it."""
    if not len(keys):
        return keys, nodes, np.zeros((0, 2), np.int64)
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    head = np.r_[True, keys[1:] != keys[:-1]]
    least = np.minimum.reduceat(nodes, np.flatnonzero(head))
    to = least[np.cumsum(head) - 1]
    other = nodes != to
    a, b = nodes[other], to[other]
    _, first = np.unique(tokens.joined(a.view(np.uint64), b.view(np.uint64)), return_index=True)
    return keys[head], least, np.column_stack([a[first], b[first]])


def star_edges(rows: DataFrame, produce: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], n_pairs: float) -> DataFrame:
    """Edges (a, b), some of them repeated, that connect all nodes with a band key in common.

    ``produce`` turns batches of rows into nodes (int64) and their band keys (a row of
    uint64 each).  Each task first joins up its own, so of a key that is everywhere only
    one node a task is sent on; keys go to buckets by their leading bits, as many as
    the number of pairs asks for, packed into arrays.
    """
    bits = max(0, math.ceil(math.log2(max(1, n_pairs / BUCKET_PAIRS))))

    def emit(keys: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        keys, nodes, edges = _stars(keys, nodes)
        buckets = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        at = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]]) if len(keys) else np.zeros(0, np.int64)
        ends = np.r_[at[1:], len(keys)] if len(at) else at
        out = [(int(buckets[s]), keys[s:e].tobytes(), nodes[s:e].tobytes(), b"") for s, e in zip(at, ends)]
        for s in range(0, len(edges), 50_000):
            out.append(((s // 50_000 + int(keys[0] % 2**31)) % 2**bits, b"", b"", edges[s : s + 50_000].tobytes()))
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "keys", "nodes", "edges"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, size = [], [], 0
        for node, key in produce(batches):
            keys.append(key.ravel())
            nodes.append(np.repeat(node, key.shape[1]))
            size += key.size
            if size > 2_000_000:
                yield emit(np.concatenate(keys), np.concatenate(nodes))
                keys, nodes, size = [], [], 0
        if size:
            yield emit(np.concatenate(keys), np.concatenate(nodes))

    def join(t: pa.Table) -> pa.Table:
        raw = [b"".join(t.column(c).to_pylist()) for c in ("keys", "nodes", "edges")]
        _, _, edges = _stars(np.frombuffer(raw[0], np.uint64), np.frombuffer(raw[1], np.int64))
        edges = np.concatenate([edges.reshape(-1, 2), np.frombuffer(raw[2], np.int64).reshape(-1, 2)])
        return pa.Table.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=EDGES)

    packed = rows.mapInArrow(pack, "bucket int, keys binary, nodes binary, edges binary")
    return packed.groupBy("bucket").applyInArrow(join, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node that it is connected to.

    Large-star and small-star steps in turn: each links the neighbours of a node to the
    least of them, until nothing changes.  Minima are aggregated before they are joined:
    by a broadcast where there are at most BROADCAST_NODES, else as a written table, so
    that Spark can split a star's many neighbours.  Each round is written to the shared
    folder and the one before deleted, so no plan and no group grows.  Raises
    RuntimeError if ``rounds`` do not suffice (they shrink paths by a constant factor each).
    """
    spark, drop = edges.sparkSession, []
    swap = lambda e: e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = lambda e: e.groupBy("a").agg(F.min("b").alias("m"))

    def write(e: DataFrame) -> tuple[DataFrame, str, tuple]:
        """Writes these different edges; what tells whether they have changed is counted while they are written."""
        seen = Observation()
        out, path = saved(e.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("all")), "edges")
        return out, path, (seen.get["n"], seen.get["all"])

    now, path, seen = write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def hop(e: DataFrame, low: DataFrame) -> DataFrame:
        if 2 * seen[0] > BROADCAST_NODES:
            low, where = saved(low, "least")
            drop.append(where)
            return e.join(low, "a")
        return e.join(F.broadcast(low), "a")

    for k in range(rounds + 1):
        if not seen[0]:
            break
        if k == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        both = now.unionByName(swap(now))
        large = hop(both, least(both).select("a", F.least("a", "m").alias("m"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = least(large)
        small = hop(large, low).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last = path
        now, path, new = write(small)
        discard(spark, last, *drop)
        drop.clear()
        if new == seen:
            break
        seen = new
    stays(path)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections, from the elements that several sets hold."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]], float)
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    same = flat[1:] == flat[:-1]
    keep = np.r_[same, False] | np.r_[False, same]
    flat, of = flat[keep], of[keep]
    column = np.cumsum(np.r_[0, flat[1:] != flat[:-1]]) if len(flat) else flat
    total = np.zeros((len(sets), len(sets)), np.float64)
    bounds = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 8192, 8192))
    for s, e in zip(bounds[:-1], bounds[1:]):
        if e > s:
            m = np.zeros((len(sets), 8192), np.float32)
            m[of[s:e], column[s:e] % 8192] = 1
            total += m @ m.T
    return total


def _forest(n: int, known: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """As few of the pairs as connect what all of them connect beyond the known ones."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k, (i, j) in enumerate(known.tolist() + pairs.tolist()):
        a, b = top(i), top(j)
        if a != b:
            up[max(a, b)] = min(a, b)
            if k >= len(known):
                out.append((i, j))
    return out


@dataclass(frozen=True)
class Shape:
    """How texts become shingles (hashes and offsets of an array of texts), and these band keys."""

    shingle: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    bands: int
    rows: int


def linked(raw: pa.Array, node: np.ndarray, group: np.ndarray, tile: np.ndarray, across: bool, keys: np.ndarray | None, band: int, shape: Shape, threshold: float, counts: bool) -> pa.Table:
    """(node, other, links) of one unit; see verified()."""
    g, off = shape.shingle(raw)
    own = np.lexsort((node, group))
    own = own[np.r_[True, (group[own][1:] != group[own][:-1]) | (node[own][1:] != node[own][:-1])]]
    head = np.flatnonzero(np.r_[True, group[own][1:] != group[own][:-1]])
    size = np.diff(np.r_[head, len(own)])
    members = np.repeat(size, size)
    found = [_few(g, off, own, np.flatnonzero((members > 1) & (members <= FEW)), group, threshold)]
    for s, n in zip(head[size > FEW], size[size > FEW]):
        held = [np.unique(g[off[i] : off[i + 1]]) for i in own[s : s + n]]
        found.append(s + np.column_stack(np.nonzero(np.triu(_alike(held, threshold), 1))))
    pair = np.concatenate(found)
    apart = tile[own[pair[:, 0]]] != tile[own[pair[:, 1]]]
    # units of one tile tell what hangs together inside it; only what joins tiles is new here
    inside, pair = (pair[~apart], pair[apart]) if across else (pair[:0], pair)
    if counts and keys is not None:  # a pair counts in the first band that it shares
        earlier = np.zeros(len(pair), bool)
        for j in range(band):
            earlier |= keys[own[pair[:, 0]], j] == keys[own[pair[:, 1]], j]
        pair = pair[~earlier]
    ids = node[own]
    links = np.bincount(pair.ravel(), minlength=len(own)) if counts else np.zeros(len(own), np.int64)
    some = np.flatnonzero(links)
    tree = np.array(_forest(len(own), inside, pair), np.int64).reshape(-1, 2)
    other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[tree[:, 1]])])
    return pa.Table.from_arrays([pa.array(np.r_[ids[some], ids[tree[:, 0]]]), other, pa.array(np.r_[links[some], np.zeros(len(tree), np.int64)])], ["node", "other", "links"])


def _alike(held: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of these sets are similar enough, as a matrix."""
    n = np.array([len(x) for x in held], float)
    common = _common(held)
    return common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9


def _few(g: np.ndarray, off: np.ndarray, own: np.ndarray, at: np.ndarray, group: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs of places in ``own`` that are similar enough, of the groups of up to FEW members that stand at ``at``, all in one pass."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    count = np.diff(off)[own[at]]
    to = np.cumsum(count)
    of = np.repeat(np.arange(len(at)), count)
    mine = np.arange(to[-1]) + np.repeat(off[own[at]] - to + count, count)
    label = np.cumsum(np.r_[0, group[own[at]][1:] != group[own[at]][:-1]])
    # a bijection for each group, so that equal shingles of different groups stand apart; the lowest bits name the member
    bits = np.uint64(len(at).bit_length())
    key = np.sort(tokens.mix(g[mine] ^ tokens.mix((label + 1).astype(np.uint64))[of]) >> bits << bits | of.astype(np.uint64))
    key = key[np.r_[True, key[1:] != key[:-1]]]
    key, of = key >> bits, (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    n = np.bincount(of, minlength=len(at))
    pairs = []
    i = np.arange(len(key))
    for step in range(1, FEW):
        i = i[i + step < len(key)]
        i = i[(key[i] == key[i + step]) & (label[of[i]] == label[of[i + step]])]
        if not len(i):
            break
        pairs.append(of[i] * len(at) + of[i + step])
    pair, common = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
    a, b = pair // len(at), pair % len(at)
    link = common >= threshold * (n[a] + n[b] - common) - 1e-9
    return np.column_stack([at[a[link]], at[b[link]]])


def verified(edges: DataFrame, fetch: Callable[[DataFrame], DataFrame], shape: Shape, threshold: float, counts: bool = True) -> DataFrame:
    """Rows (node, other, links): exact links among the nodes that share a band key.

    ``fetch`` gives (node, raw: its text in UTF-8) for the nodes asked for, one row each (see
    once()); a text is cut into shingles where it is compared.  Candidates are grouped by the components of their edges.
    Members of a group of up to TILE are compared in one unit.  A larger group is
    compared in the way that sends fewer texts: whole, cut into tiles of about TILE members, each pair of
    tiles a unit; or (a group that unlike nodes have chained together) by its buckets of
    equal band keys, each cut into tiles in the same way, a pair being counted in the first
    band that it shares.  No task holds a large group, no pair becomes a row, and only
    texts linked by nothing but a chain go uncompared.  A row with links > 0 counts links of a node
    within one unit (if ``counts`` are asked for); a row with ``other`` is an edge of a spanning forest.
    Where no counts are asked for, members of a whole group first meet its least node alone (starred()):
    those linked to it hang together, so only the others still meet all, and a group of n that are
    all alike is compared in n steps.
    """
    groups = cut(components(edges).select("node", F.col("root").alias("group")))
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    tiled = groups.join(sizes.select("group", F.ceil(F.col("n") / TILE).alias("tiles")), "group")
    total, most = tiled.agg(F.count("*"), F.coalesce(F.max("tiles"), F.lit(0))).first()
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile")
    none = F.lit(None).cast("array<long>").alias("keys")
    texts = fetch(groups) if most <= 1 else cut(fetch(groups))
    small = tiled.where("tiles = 1").join(texts, "node").select(
        F.pmod(F.xxhash64("group"), F.lit(max(1, total // 256))).alias("unit"), F.lit(-1).alias("band"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "group", "node", F.lit(0).alias("tile"), "raw", none
    )
    rows, known = small, None
    if most > 1:
        keyed = with_keys(texts.join(tiled.where("tiles > 1"), "node", "left_semi"), shape)
        many = cut(tiled.where("tiles > 1").join(keyed, "node"))
        member = cut(many.select("group", "node", F.posexplode("keys").alias("band", "key")))
        bucket = cut(member.groupBy("group", "band", "key").agg(F.count("*").alias("n")).where("n > 1").select("group", "band", "key", F.ceil(F.col("n") / TILE).alias("cuts"), "n"))
        cost = bucket.groupBy("group").agg(F.sum(F.col("n") * F.col("cuts")).alias("by_bucket"))
        whole = many.groupBy("group").agg(F.sum("tiles").alias("by_tile")).join(cost, "group", "left")
        way = cut(whole.select("group", (F.coalesce("by_bucket", F.lit(0)) < F.col("by_tile")).alias("buckets")))
        dealt = many.join(way, "group")
        ends = lambda df: _units(df, F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int")))
        columns = ("unit", "band", "lo", "hi", "group", "node", "tile", "raw", "keys")
        if counts:
            by_tile = ends(dealt.where("not buckets").select("*", own))
        else:
            star = starred(dealt.where("not buckets").select("group", "node", "raw"), shape, threshold)
            known = star.where("linked and node <> head").select("node", F.col("head").alias("other"), F.lit(0).cast("long").alias("links"))
            by_tile = _beyond(star)
        by_tile = by_tile.withColumns({"unit": F.col("group"), "band": F.lit(-2)}).withColumn("keys", none).select(*columns)
        # keys that no other member has go before the texts come in
        shared = bucket.join(way.where("buckets"), "group").select("group", "band", "key", F.col("cuts").alias("tiles"))
        spread = member.join(shared, ["group", "band", "key"]).join(many.select("node", "raw", "keys"), "node")
        # a key belongs to one group, so small buckets of a band share a unit, in which each key is a group
        units = max(1, bucket.where("cuts = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // (256 * shape.bands))
        unit = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("key"), F.lit(units))).otherwise(F.xxhash64("group", "key"))
        by_bucket = ends(spread.select("*", own)).withColumn("unit", unit).select(*columns)
        rows = small.unionByName(by_tile).unionByName(by_bucket)

    def check(t: pa.Table) -> pa.Table:
        group, node, tile = (np.asarray(t.column(c)) for c in ("group", "node", "tile"))
        band, across = t.column("band")[0].as_py(), t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        keys = None
        if band >= 0:
            keys = np.asarray(t.column("keys").combine_chunks().flatten()).reshape(len(node), shape.bands)
            group = keys[:, band]
        return linked(t.column("raw").combine_chunks(), node, group, tile, across, keys, band, shape, threshold, counts)

    out = rows.groupBy("unit", "band", "lo", "hi").applyInArrow(check, "node long, other long, links long")
    return cut(out.unionByName(known) if known is not None else out)


def _units(rows: DataFrame, others) -> DataFrame:
    """Each row once for each of the tiles that its tile is compared with; lo and hi name the unit."""
    return rows.withColumn("j", F.explode(others)).withColumn("lo", F.least("tile", "j")).withColumn("hi", F.greatest("tile", "j"))


def starred(members: DataFrame, shape: Shape, threshold: float) -> DataFrame:
    """group, node, raw, head (the least node of the group) and linked: whether the two are similar enough."""
    heads = members.groupBy("group").agg(F.min("node").alias("head"))
    texts = cut(members.join(heads, "group").where("node = head").select("group", "head", F.col("raw").alias("head_raw")))
    few = texts.agg(F.coalesce(F.sum(F.length("head_raw") + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (g, at), (h, to) = (shape.shingle(b.column(b.schema.get_field_index(c))) for c in ("raw", "head_raw"))
            near = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = np.unique(g[at[i] : at[i + 1]]), np.unique(h[to[i] : to[i + 1]])
                common = len(np.intersect1d(x, y, assume_unique=True))
                near[i] = common >= threshold * (len(x) + len(y) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("group", "node", "raw", "head")), pa.array(near)], ["group", "node", "raw", "head", "linked"])

    return cut(members.join(F.broadcast(texts) if few else texts, "group").mapInArrow(run, "group long, node long, raw binary, head long, linked boolean"))


def _beyond(star: DataFrame) -> DataFrame:
    """Rows of units that compare what is not linked to its head with everything in its group."""
    size = star.groupBy("group").agg(F.ceil(F.count_if("linked") / TILE).cast("int").alias("near"), F.ceil(F.count_if(~F.col("linked")) / TILE).cast("int").alias("far")).where("far > 0")
    h = F.xxhash64("node")
    tile = F.when(F.col("linked"), F.pmod(h, F.greatest("near", F.lit(1)))).otherwise(F.col("near") + F.pmod(h, F.col("far"))).cast("int")
    others = F.sequence(F.when(F.col("linked"), F.col("near")).otherwise(F.lit(0)), F.col("near") + F.col("far") - 1)
    return _units(star.join(size, "group").withColumn("tile", tile), others)


def with_keys(have: DataFrame, shape: Shape) -> DataFrame:
    """(node, raw) with the band keys of each text; texts have a shingle at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = tokens.band_keys(tokens.min_hashes(*shape.shingle(b.column(1)), shape.bands * shape.rows), shape.rows).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, shape.bands, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["node", "raw", "keys"])

    return have.select("node", "raw").mapInArrow(run, "node long, raw binary, keys array<long>")


def once(texts: DataFrame, repeated: bool) -> DataFrame:
    """One text of each node.  Repeated rows lend one each; where there are none, nothing needs to be shuffled."""
    return texts.groupBy("node").agg(F.first("raw").alias("raw")) if repeated else texts


def pick(rows: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is among ids; broadcast only if ids are few."""
    ids = ids.select(on).distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids, on, "left_semi")
