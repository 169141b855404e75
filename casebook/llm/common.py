"""Helpers shared by the training-data operators.

Text is handled in bounded chunks inside a task, intermediate tables go to the shared
checkpoint folder, and fold membership is computed from the id on the JVM side.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that is worked on together inside a task.
CHUNK_BYTES = 1 << 20


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, also when the
    session was started without it on its path (``--py-files`` does the same on a cluster)."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, ROOT])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def doc_texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and whole text (null: empty) under fixed names; every other column is left out,
    so clashing names in the input cannot matter."""
    reach_workers(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       *[F.col(c) for c in extra])


def named(column: str, inside: str = "") -> Column:
    """The column of exactly this name (dots and backticks taken literally), of a struct if named."""
    quoted = "`" + column.replace("`", "``") + "`"
    return F.col(f"{inside}.{quoted}" if inside else quoted)


def row_key() -> Column:
    """64-bit key of a (doc_id, text) row; repeated rows share it."""
    return F.xxhash64("doc_id", "text")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: one computation for
    several readers, a cut lineage, and no data that dies with an executor.  The folder is
    removed when the application ends."""
    from casebook.plans.stage import materialise
    return materialise(df)


def chunks(batch: pa.RecordBatch, column: str = "text",
           max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` holding about ``max_bytes`` of ``column`` (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes) // max_bytes
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only


def give_back() -> None:
    """Return freed memory to the system: a Python worker is kept for later stages, beside the
    executor's heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, with ``give_back`` after the work on each."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def ragged(values: np.ndarray, lengths: list[int] | np.ndarray, kind=None) -> pa.ListArray:
    """Arrow list column from flat values and per-row lengths."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


class Memo(dict):
    """word -> value cache of one Python worker, in two generations of at most ``limit`` words:
    a full generation becomes the old one, whose words come over when they are asked for
    again, and the old one before it is dropped.  Memory stays bounded however many
    distinct words go by, and words in use are kept."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit
        self.old: dict = {}

    def need(self, words) -> list:
        """Those of ``words`` that the caller must add; the others can be read until the next call."""
        if len(self) + len(words) > self.limit:
            self.old = dict(self)
            self.clear()
        missing = [w for w in words if w not in self]
        if self.old:
            again = {w: self.old[w] for w in missing if w in self.old}
            if again:
                self.update(again)
                missing = [w for w in missing if w not in again]
        return missing
