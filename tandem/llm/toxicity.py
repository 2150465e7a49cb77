"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .labelled import remainder, sample

ORDERS = (4, 5, 6)
BITS = 18
#: Bounds of what is fitted on: rows of each label, and bytes of all texts.
FIT_ROWS, FIT_BYTES = 1500, 12_000_000
#: Weight of a toxic row against another one, ridge penalty and steps of the fit.
TOXIC_WEIGHT, RIDGE, STEPS = 4.0, 1e-6, 30
#: Added to the counts before the ratio.
SMOOTH = 1.0


class Grams:
    """Hashes of the different n-grams of a text, in [0, 2^BITS)."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        parts, h = [], cp
        for n in range(2, max(ORDERS) + 1):
            if len(cp) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + cp[n - 1 :]
            if n in ORDERS:
                parts.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(64 - BITS))
        if not parts:
            return np.zeros(0, np.int32)
        g = np.concatenate(parts).astype(np.int64)
        place = np.arange(len(g))
        self.seen[g] = place  # of equal ones the last stays
        return g[self.seen[g] == place].astype(np.int32)


@dataclass(frozen=True)
class Model:
    """weights: of the scaled features; scale: squares of the ratios; None without labels of both kinds."""

    weights: np.ndarray | None
    scale: np.ndarray | None
    intercept: float

    def scores(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        if self.weights is not None:
            grams = Grams()
            for i, t in enumerate(texts):
                if t and len(g := grams(t)):
                    out[i] += self.weights[g].sum() / np.sqrt(max(self.scale[g].sum(), 1e-9))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def minimise(f, x: np.ndarray, steps: int) -> np.ndarray:
    """Limited-memory quasi-Newton steps with backtracking; f returns value and gradient."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, coefs = g.copy(), []
        for s, y in reversed(past):
            a = (s @ d) / (y @ s)
            coefs.append(a)
            d -= a * y
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(d), 1e-9)
        for (s, y), a in zip(past, reversed(coefs)):
            d += s * (a - (y @ d) / (y @ s))
        step = 1.0
        for _ in range(12):
            new, new_g = f(x - step * d)
            if new < value:
                break
            step /= 3
        else:
            return x
        s, y = -step * d, new_g - g
        if y @ s > 1e-12:
            past = [*past[-7:], (s, y)]
        x, value, g = x - step * d, new, new_g
    return x


def fit(rows: list[tuple[str, int]]) -> Model:
    """Presence of n-grams, times log-count ratio, to unit length, then logistic regression.

    Without rows of both labels every text gets the share of toxic rows (0.5 without rows).
    """
    y = np.array([label for _, label in rows], float)
    if len(set(y)) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model(None, None, float(np.log(rate / (1 - rate))))
    grams, size = Grams(), 1 << BITS
    found = [grams(t) for t, _ in rows]
    counts = [np.full(size, SMOOTH), np.full(size, SMOOTH)]
    for g, label in zip(found, y):
        counts[int(label)][g] += 1
    ratio = np.log(counts[1] / (y.sum() + 2 * SMOOTH)) - np.log(counts[0] / ((1 - y).sum() + 2 * SMOOTH))
    cost = np.where(y == 1, TOXIC_WEIGHT, 1.0)
    cost /= cost.sum()
    blocks = []  # of rows, so that what a step holds beside the features stays small
    for s in range(0, len(found), 100):
        part = found[s : s + 100]
        at, of = np.concatenate(part), np.repeat(np.arange(len(part)), [len(g) for g in part])
        length = 1 / np.sqrt(np.maximum(np.bincount(of, ratio[at] ** 2, minlength=len(part)), 1e-9))
        blocks.append((at, np.array([len(g) for g in part]), length, y[s : s + 100], cost[s : s + 100]))
    del found

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = x[:-1], x[-1]
        v, value, grad, bias = ratio * w, 0.0, np.zeros(size), 0.0
        for at, n, length, label, own in blocks:
            of = np.repeat(np.arange(len(n)), n)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(of, v[at], minlength=len(n)) * length + b, -30, 30)))
            e = (p - label) * own
            grad += np.bincount(at, (e * length)[of], minlength=size)
            bias += e.sum()
            value -= (own * np.log(np.where(label == 1, p, 1 - p) + 1e-12)).sum()
        return float(value + RIDGE / 2 * (w @ w)), np.r_[grad * ratio + RIDGE * w, bias]

    x = minimise(loss, np.zeros(size + 1), STEPS)
    return Model((ratio * x[:-1]).astype(np.float32), (ratio**2).astype(np.float32), float(x[-1]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample (FIT_ROWS of each label, FIT_BYTES) of the rows that may be learned from."""
    return fit(sample(docs, labels, "toxic", remainder(5) != 0, FIT_ROWS, FIT_BYTES))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each whole text, 0 to 1; null, empty and very short texts get that of no feature.

    Repeated rows are scored alike; a column of ``docs`` that is already called ``out`` raises ValueError.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    if out in docs.columns:
        raise ValueError(f"the table already has {out}")

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([t or "" for t in batch]))

    return docs.withColumn(out, F.pandas_udf(run, "double")(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
