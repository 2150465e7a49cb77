"""Small helpers that several operators share; discard, scratch and setting are those of the library."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import discard, scratch, setting

#: Maximal runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


#: Rows of an Arrow batch: texts are long, and two tasks share an executor's memory with the JVM.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; also keeps the session's Arrow batches to BATCH_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, and its path, for discard().

    That cuts the lineage: a lost executor costs no more than the tasks it ran.  Spark
    deletes the shuffle files of the plan when the table is written.
    """
    path = scratch(df.sparkSession, name)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: Paths that cut() has written inside passing().
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete what cut() writes, or stays() names, inside the block when it ends: the result has been written by then."""
    token = _passing.set(paths := [])
    try:
        yield
    finally:
        _passing.reset(token)
        discard(spark, *paths)


def cut(df: DataFrame) -> DataFrame:
    """saved(), for a table that the result reads and so must stay (but see passing())."""
    out, path = saved(df)
    stays(path)
    return out


def stays(path: str) -> None:
    """Say that a result reads what saved() has written there: passing() then deletes it, and nobody else."""
    if (paths := _passing.get()) is not None:
        paths.append(path)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(id_col: str, col: str) -> Column:
    """Names a row by its id and text: repeated ids with other texts stay apart."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(F.col(col)).cast("string"))


def pack(array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string or binary array as one byte buffer and n + 1 offsets; null is empty."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]
