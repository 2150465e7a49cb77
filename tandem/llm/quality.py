"""Quality classifier: how much better a text compresses with a dictionary of good text."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .labelled import remainder, sample

#: Bytes in a piece that is compressed by itself, so that the dictionary counts in every part of a long text.
PIECE = 256
DICTIONARY_BYTES = 65536
LEVEL = 3
#: Bounds of what is fitted on: rows of each label, and bytes of all texts.
FIT_ROWS, FIT_BYTES = 3000, 24_000_000
#: Pieces of each label that a dictionary is built from.
FIT_PIECES = 8000


def pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there are too few samples to train one, their bytes."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


#: Bytes below which a text is short: its difference says less.
SHORT = 100


def features(difference: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The difference, how short the text is (0 to 1), and their product."""
    short = 1 / (1 + np.asarray(size, float) / SHORT)
    return np.column_stack([difference, short, difference * short])


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the logistic calibration of the difference they make."""

    good: bytes
    bad: bytes
    slope: tuple[float, float, float]
    intercept: float

    def differences(self, texts) -> np.ndarray:
        """(bytes with the bad dictionary - bytes with the good one) / bytes of the text; 0 if empty."""
        if not self.good or not self.bad:
            return np.zeros(len(texts))
        make = lambda d: zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        good, bad = make(self.good), make(self.bad)
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if t:
                parts = pieces(t)
                out[i] = sum(len(bad.compress(x)) - len(good.compress(x)) for x in parts) / sum(map(len, parts))
        return out

    def scores(self, texts) -> np.ndarray:
        size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
        z = features(self.differences(texts), size) @ np.array(self.slope) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Slopes and intercept by Newton steps, on standardised columns."""
    mean, std = x.mean(0), x.std(0) + 1e-12
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (p - y) + ridge * w)
    slope = w[:-1] / std
    return slope, float(w[-1] - slope @ mean)


def fit(rows: list[tuple[str, int]]) -> Model:
    """Half of the rows build the dictionaries, the other half calibrates.

    The halves are told apart by a hash of the text, so copies stay on one side.
    Without rows of both labels every text gets the share of good rows (0.5 without rows).
    """
    rate = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    flat = math.log(rate / (1 - rate))
    half = [hashlib.sha1(t.encode("utf-8", "surrogatepass")).digest()[0] & 1 for t, _ in rows]
    stock = {y: [p for (t, label), h in zip(rows, half) if h == 0 and label == y for p in pieces(t) if len(p) >= 16] for y in (0, 1)}
    held = [(t, y) for (t, y), h in zip(rows, half) if h == 1 and t]
    if not stock[0] or not stock[1] or len({y for _, y in held}) < 2:
        return Model(b"", b"", (0.0, 0.0, 0.0), flat)
    pick = lambda s: s if len(s) <= FIT_PIECES else [s[i] for i in np.random.default_rng(0).permutation(len(s))[:FIT_PIECES]]
    raw = Model(dictionary(pick(stock[1])), dictionary(pick(stock[0])), (0.0, 0.0, 0.0), 0.0)
    texts = [t for t, _ in held]
    slope, intercept = logistic(features(raw.differences(texts), [len(t.encode("utf-8", "surrogatepass")) for t in texts]), np.array([y for _, y in held], float))
    return Model(raw.good, raw.bad, tuple(slope.tolist()), intercept)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample (FIT_ROWS of each label, FIT_BYTES) of the rows that may be learned from."""
    return fit(sample(docs, labels, "quality", remainder(4) != 2, FIT_ROWS, FIT_BYTES))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each whole text, 0 to 1; null and empty texts get the calibration's value at no difference.

    Long texts are scored in pieces, all of them; repeated rows are scored alike; an empty table gives an
    empty one; a column of ``docs`` that is already called ``out`` raises ValueError.
    """

    if out in docs.columns:
        raise ValueError(f"the table already has {out}")

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(model.scores([t or "" for t in batch]))

    return docs.withColumn(out, F.pandas_udf(run, "double")(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
