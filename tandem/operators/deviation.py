"""Ridge fit over all entities and the deviation of each entity from it.

Entities are sparse rows: sorted positions of predictors and targets, and their values.  They
are made dense only in numpy, some rows and one strip of columns at a time.  Every matrix
(the Gram matrix, the system, the weights) is a table of blocks of BLOCK x BLOCK values, so
none is ever whole in one place; only what has p + q entries is on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import discard, saved

#: Rows and columns of a block.
BLOCK = 512
#: Bytes of the strip of the Gram matrix that a task holds.
STRIP_BYTES = 256_000_000
#: Bytes of dense rows that a task makes at a time.
DENSE_BYTES = 32_000_000
#: Tasks that sum up one strip of the Gram matrix: each sends the whole strip once.
GRAM_TASKS = 2000
#: Bytes of weights, or of a panel of the system, that are broadcast; more go in several passes, or by a shuffle.
BROADCAST_BYTES = 64_000_000
BLOCKS = "i int, j int, data binary"


# -- sparse rows -------------------------------------------------------------------


@dataclass
class Layout:
    """Places of features: predictors from 0 to p - 1, targets from p to p + q - 1."""

    names: DataFrame  #: feature (feature_type too, if it is known), side (x or y) and pos
    p: int
    q: int


def layout(x_features: DataFrame, y_features: DataFrame, order: Column | str = "feature") -> Layout:
    """Number the features of both sides, each side in the given order.

    A feature is (feature_type, feature) where both tables tell its type, so one name may be a
    predictor in one type and a target in another.
    """
    key = [c for c in ("feature_type", "feature") if c in x_features.columns and c in y_features.columns]
    side = lambda df, s: df.select(*key, F.lit(s).alias("side"), (F.col(order) if isinstance(order, str) else order).alias("_order"))
    both = side(x_features, "x").unionByName(side(y_features, "y"))
    n = {r["side"]: r["n"] for r in both.groupBy("side").agg(F.count("*").alias("n")).collect()}
    place = F.row_number().over(Window.orderBy("side", "_order", *key)) - 1  # one row for each feature
    return Layout(both.withColumn("pos", place).select(*key, "side", "pos"), n.get("x", 0), n.get("y", 0))


def vectors(long: DataFrame, cells: DataFrame, to: Layout) -> DataFrame:
    """cell_id, pos, value: the sorted places of each cell's values; cells without any have empty arrays.

    Values of a feature that a cell holds twice are added up.
    """
    key = [c for c in ("feature_type", "feature") if c in long.columns and c in to.names.columns]
    entry = F.struct("pos", F.col("value").cast("double").alias("value"))
    rows = long.join(to.names.select(*key, "pos"), key).groupBy("cell_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    part = lambda f, kind: F.coalesce(F.col(f"e.{f}"), F.array().cast(f"array<{kind}>")).alias(f)
    return cells.select("cell_id").join(rows, "cell_id", "left").select("cell_id", part("pos", "int"), part("value", "double"))


def _dense(b: pa.RecordBatch, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """The columns from lo to hi of the rows of a batch, some rows at a time, each with its first row."""
    pos, value = b.column("pos"), b.column("value")
    off, at = pos.offsets.to_numpy(), pos.values.to_numpy()
    v, v_off = value.values.to_numpy(zero_copy_only=False), value.offsets.to_numpy()
    step = max(1, DENSE_BYTES // (8 * (hi - lo)))
    for s in range(0, b.num_rows, step):
        e = min(s + step, b.num_rows)
        out = np.zeros((e - s, hi - lo))
        here, val = at[off[s] : off[e]], v[v_off[s] : v_off[e]]
        row = np.repeat(np.arange(e - s), np.diff(off[s : e + 1]))
        own = (here >= lo) & (here < hi)
        np.add.at(out, (row[own], here[own] - lo), val[own])
        yield s, out


# -- fit ---------------------------------------------------------------------------


@dataclass
class Ridge:
    """A fitted model: weights in blocks (i of predictors, j of targets), and the means of all places."""

    spark: SparkSession
    weights: DataFrame
    mean: np.ndarray
    p: int
    q: int

    def coefficients(self) -> DataFrame:
        """target, predictor (places on their sides) and weight, a row for each of the p x q."""
        p, q = self.p, self.q

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j, data in zip(*(b.column(c).to_pylist() for c in ("i", "j", "data"))):
                    w = np.frombuffer(data).reshape(_size(i, p), _size(j, q))
                    at, to = np.indices(w.shape)
                    yield pa.RecordBatch.from_arrays([pa.array((to.ravel() + j * BLOCK).astype(np.int32)), pa.array((at.ravel() + i * BLOCK).astype(np.int32)), pa.array(w.ravel())], ["target", "predictor", "weight"])

        return self.weights.mapInArrow(rows, "target int, predictor int, weight double")

    def intercepts(self) -> DataFrame:
        """target and its intercept, the mean less the weighted means of the predictors."""
        p, q, mean = self.p, self.q, self.mean

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j, data in zip(*(b.column(c).to_pylist() for c in ("i", "j", "data"))):
                    w = np.frombuffer(data).reshape(_size(i, p), _size(j, q))
                    own = -(mean[i * BLOCK : i * BLOCK + len(w)] @ w) + (mean[p + j * BLOCK : p + j * BLOCK + w.shape[1]] if i == 0 else 0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32) + j * BLOCK), pa.array(own)], ["target", "b"])

        return self.weights.mapInArrow(part, "target int, b double").groupBy("target").agg(F.sum("b").alias("b"))


def _size(k: int, n: int) -> int:
    return min(BLOCK, n - k * BLOCK)


def _blocks(n: int) -> int:
    return math.ceil(n / BLOCK)


def column_means(rows: DataFrame, size: int) -> np.ndarray:
    """The mean of each place, from one sum a place and partition."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size), 0
        for b in batches:
            n += b.num_rows
            total += np.bincount(b.column("pos").flatten().to_numpy(), b.column("value").flatten().to_numpy(zero_copy_only=False), size)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total), pa.array(np.full(size, n))], ["i", "s", "n"])

    found = rows.select("pos", "value").mapInArrow(partial, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean")).toPandas()
    if not len(found):
        raise ValueError("fit_ridge needs at least one row")
    out = np.zeros(size)
    out[found["i"]] = found["mean"]
    return out


def _add(key: tuple, t: pa.Table) -> pa.Table:
    """The sum of blocks of one place."""
    data = t.column("data")
    total = np.frombuffer(data[0].as_buffer()).copy()
    for x in data[1:] if len(data) > 1 else ():
        total += np.frombuffer(x.as_buffer())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "j", "data"])


def gram(rows: DataFrame, mean: np.ndarray, p: int, q: int, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """Blocks (i, j) of the products of predictors with predictors (i <= j) and with targets, values less their means.

    Columns of predictors are blocks 0 to K - 1, those of targets K and on.  A task sums a strip of
    at most ``strip_bytes`` over all its rows, a pass over the rows for each strip; blocks are then
    added in two steps, so no task adds up more than a share of them.
    """
    k, size = _blocks(p), p + q

    def start(j: int) -> int:
        return j * BLOCK if j < k else p + (j - k) * BLOCK

    def strip(lo: int, hi: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, last = lo * BLOCK, min(hi * BLOCK, p)
            total, some = np.zeros((last - first, size - first)), False
            for b in batches:
                for _, v in _dense(b, first, size):
                    v -= mean[first:]
                    total += v[:, : last - first].T @ v
                    some = True
            for i in range(lo, hi) if some else ():
                for j in range(i, k + _blocks(q)):
                    wide = _size(j, p) if j < k else _size(j - k, q)
                    part = total[i * BLOCK - first : i * BLOCK - first + _size(i, p), start(j) - first : start(j) - first + wide]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["i", "j", "data"])

        return rows.select("pos", "value").coalesce(GRAM_TASKS).mapInArrow(run, BLOCKS)

    high = max(1, strip_bytes // (8 * size) // BLOCK)
    parts = reduce(DataFrame.unionAll, [strip(lo, min(lo + high, k)) for lo in range(0, k, high)]).withColumn("salt", F.spark_partition_id() % 32)
    return parts.groupBy("i", "j", "salt").applyInArrow(_add, BLOCKS).groupBy("i", "j").applyInArrow(_add, BLOCKS)


def _joined(left: DataFrame, right: DataFrame, on: str, size: int, limit: int) -> DataFrame:
    """Blocks meet a panel of ``size`` bytes: it is broadcast if it is small, and dealt out by key if not."""
    return left.join(F.broadcast(right) if size <= limit else right.hint("merge"), on)


def solve(system: DataFrame, p: int, q: int, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, list[str]]:
    """Blocks (i, j) of W in A W = B by Gauss-Jordan elimination of one block of columns at a time.

    ``system`` holds the blocks of A (p x p, symmetric and positive definite, so diagonal blocks stay
    regular in any order) and, from column K on, of B (p x q).  In each of the K steps the row of the
    pivot is solved for and taken off all other rows; columns that are done are dropped.  A step is
    two written tables, so a lost executor costs no more than its tasks.
    """
    spark, k = system.sparkSession, _blocks(p)
    state, paths = system, []

    def pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j, data, d in zip(*(b.column(c).to_pylist() for c in ("j", "data", "d"))):
                a = np.frombuffer(d)
                n = math.isqrt(len(a))
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([np.linalg.solve(a.reshape(n, n), np.frombuffer(data).reshape(n, -1)).tobytes()], pa.binary())], ["j", "r"])

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, c, r, n in zip(*(b.column(x).to_pylist() for x in ("i", "j", "data", "c", "r", "n"))):
                out = np.frombuffer(data) - (np.frombuffer(c).reshape(-1, n) @ np.frombuffer(r).reshape(n, -1)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["i", "j", "data"])

    for at in range(k):
        n = _size(at, p)
        diagonal = state.where((F.col("i") == at) & (F.col("j") == at)).select(F.col("data").alias("d"))
        row, row_path = saved(state.where((F.col("i") == at) & (F.col("j") > at)).crossJoin(F.broadcast(diagonal)).mapInArrow(pivot, "j int, r binary"), "pivot")
        done = row.select(F.lit(at).alias("i"), "j", F.col("r").alias("data"))
        if k > 1:
            column = state.where((F.col("j") == at) & (F.col("i") != at)).select("i", F.col("data").alias("c"))
            rest = _joined(state.where((F.col("i") != at) & (F.col("j") > at)), column, "i", 8 * n * p, broadcast_bytes)
            rest = _joined(rest, row, "j", 8 * n * (p + q), broadcast_bytes)
            done = rest.select("i", "j", "data", "c", "r", F.lit(n).alias("n")).mapInArrow(update, BLOCKS).unionByName(done)
        state, path = saved(done, "system")
        discard(spark, row_path, *paths)
        paths = [path]
    return state.select("i", (F.col("j") - k).alias("j"), "data"), paths


def fit_ridge(rows: DataFrame, p: int, q: int, alpha: float = 1.0, strip_bytes: int = STRIP_BYTES, broadcast_bytes: int = BROADCAST_BYTES) -> Ridge:
    """Fit all targets on all predictors; the intercept is not penalised.

    ``rows`` holds pos and value as vectors() gives them; they are read once for the means and once
    for each strip of the Gram matrix, so write or cache them if they are dear to make.  The Gram matrix
    is that of the values less their means, so no digits are lost where means are large.  It is
    solved in blocks on the executors: the driver holds p + q means and nothing of size p x p.
    """
    mean = column_means(rows, p + q)
    k = _blocks(p)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data in zip(*(b.column(c).to_pylist() for c in ("i", "j", "data"))):
                a = np.frombuffer(data).reshape(_size(i, p), -1).copy()
                if i == j:
                    a = np.triu(a) + np.triu(a, 1).T
                    a[np.diag_indices(len(a))] += alpha
                for at, to, x in ((i, j, a), (j, i, a.T)) if i < j < k else ((i, j, a),):
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([to], pa.int32()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], ["i", "j", "data"])

    system, path = saved(gram(rows, mean, p, q, strip_bytes).mapInArrow(whole, BLOCKS), "gram")
    weights, _ = solve(system, p, q, broadcast_bytes)
    discard(rows.sparkSession, path)
    return Ridge(rows.sparkSession, weights, mean, p, q)


# -- scores ------------------------------------------------------------------------


def _tiles(p: int, q: int, limit: int) -> list[tuple[range, range]]:
    """Ranges of blocks of predictors and targets whose weights take at most ``limit`` bytes (or are one block)."""
    most = max(1, limit // (8 * BLOCK * BLOCK))
    high = min(_blocks(p), most)
    wide = max(1, most // high)
    return [(range(i, min(i + high, _blocks(p))), range(j, min(j + wide, _blocks(q)))) for i in range(0, _blocks(p), high) for j in range(0, _blocks(q), wide)]


def predict(rows: DataFrame, model: Ridge, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """cell_id, j, yhat and y: fitted and given values of each block j of targets.

    The weights are taken in tiles of at most ``broadcast_bytes``, each a broadcast and a pass over the
    rows.  Where one tile holds all predictors of a target, that is all; if there are more, each gives
    partial sums x * w, which are added by cell and block.
    """
    p, q, mean, spark = model.p, model.q, model.mean, rows.sparkSession
    own = [c for c in rows.columns if c not in ("pos", "value")]

    def scored(high: range, wide: range) -> DataFrame:
        found = model.weights.where(F.col("i").between(high[0], high[-1]) & F.col("j").between(wide[0], wide[-1])).collect()  # at most broadcast_bytes
        lo, hi, left, right = high[0] * BLOCK, min((high[-1] + 1) * BLOCK, p), wide[0] * BLOCK, min((wide[-1] + 1) * BLOCK, q)
        w = np.zeros((hi - lo, right - left))
        for r in found:
            i, j = r["i"] * BLOCK - lo, r["j"] * BLOCK - left
            w[i : i + _size(r["i"], p), j : j + _size(r["j"], q)] = np.frombuffer(r["data"]).reshape(_size(r["i"], p), -1)
        shared = spark.sparkContext.broadcast(w)
        first = high[0] == 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            for b in batches:
                for s, x in _dense(b, lo, hi):
                    fitted = (x - mean[lo:hi]) @ w + (mean[p + left : p + right] if first else 0.0)
                    part = b.slice(s, len(x))
                    y = np.concatenate([v for _, v in _dense(part, p + left, p + right)]) if first else np.zeros_like(fitted)
                    for j in wide:
                        at = slice(j * BLOCK - left, j * BLOCK - left + _size(j, q))
                        off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * _size(j, q))
                        lists = [pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(v[:, at]).ravel())) for v in (fitted, y)]
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(np.full(len(x), j, np.int32)), *lists], [*own, "j", "yhat", "y"])

        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in own)
        return rows.select(*own, "pos", "value").mapInArrow(run, f"{schema}, j int, yhat array<double>, y array<double>")

    tiles = _tiles(p, q, broadcast_bytes)
    out = reduce(DataFrame.unionAll, [scored(*t) for t in tiles])
    if all(len(high) == _blocks(p) for high, _ in tiles):
        return out
    added = lambda c: F.aggregate(F.collect_list(c), F.array_repeat(F.lit(0.0), F.first(F.size(c))), lambda a, v: F.zip_with(a, v, lambda x, y: x + y)).alias(c)
    return out.groupBy(*own, "j").agg(added("yhat"), added("y"))


def deviation_score(rows: DataFrame, model: Ridge, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """cell_id and the mean absolute residual over the targets."""
    resid = F.aggregate(F.zip_with("y", "yhat", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v)
    return predict(rows, model, broadcast_bytes).groupBy("cell_id").agg((F.sum(resid) / model.q).alias("deviation_score"))


def deviation_overview(dev: DataFrame) -> DataFrame:
    """Mean and population standard deviation."""
    return dev.agg(F.avg("deviation_score").alias("mean"), F.stddev_pop("deviation_score").alias("std"))


def deviation_by_stratum(dev: DataFrame, col: str = "cell_type", min_count: int = 50) -> DataFrame:
    """Mean, sample standard deviation and count per stratum of ``min_count`` or more, highest first."""
    out = dev.groupBy(col).agg(F.avg("deviation_score").alias("mean"), F.stddev_samp("deviation_score").alias("std"), F.count("*").alias("count"))
    return out.where(F.col("count") >= min_count).orderBy(F.desc("mean"), col)
