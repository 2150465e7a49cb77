"""Byte-level BPE by the tiktoken library, from a local file of ranks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

#: Characters after which a long text is cut at its next safe boundary.
PIECE = 1 << 16
#: A place where one match of the pattern ends and the next begins, whatever stands around it: before
#: white space that follows other text, and before a digit or a mark that follows a letter.  Only old
#: letters and marks count, on which all versions of Unicode agree.
BOUNDARY = regex.compile(
    r"\S(?=[ \t\n\r])"
    r"|[A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-яא-תا-غぁ-ゔァ-ヺ一-龥가-힣]"
    r"(?=[!-@\[-`{-~、。！，？])"
)


def read_ranks(path: str) -> bytes:
    """The file of ranks as it is, for the driver to hand to the tasks (under a MB for 50,000 ranks)."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    """The library's encoder without special tokens; one for each worker and vocabulary."""
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line.strip())
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only where matches of the pattern begin.

    A stretch without a safe boundary stays whole, so the ids are those of the whole text.
    """
    at = 0
    while len(text) - at > size and (cut := BOUNDARY.search(text, at + size)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def ids_of(enc, text: str, size: int = PIECE) -> np.ndarray:
    """Ids of a text."""
    if len(text) <= size:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(t, disallowed_special=()) for t in pieces(text, size)])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The id column and ``ids`` (array<int>), a row for each row of ``docs``.

    Each match of ``pattern`` is encoded by itself and nothing is a special token.  Null and
    empty texts give an empty array; long ones are split at safe boundaries, which changes
    no id; repeated rows are encoded each; further columns are left behind; an empty table
    gives an empty one.  No shuffle.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for b in batches:
            found = [ids_of(enc, t.as_py()) for t in b.column(1)]
            off = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
            flat = np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], [doc_id, "ids"])

    return docs.select(doc_id, text_of(text).alias("_text")).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id") -> DataFrame:
    """The id column, ``ids`` and ``decoded`` (binary): the bytes that the ids stand for, joined.

    They need not be valid UTF-8, as an id may stand for part of a character.  Null ids give no
    bytes; an id without a rank raises KeyError.
    """
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks.value, pattern)
        for b in batches:
            out = pa.array([enc.decode_bytes(x.values.to_pylist()) if x.is_valid else b"" for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out], [doc_id, "ids", "decoded"])

    return tokens.select(doc_id, "ids").mapInArrow(run, f"`{doc_id}` {tokens.schema[doc_id].dataType.simpleString()}, ids array<int>, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = decode(encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
