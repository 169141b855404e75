"""Sum-of-squares packing of documents into sequences (operator 9).

Each document becomes its token ids and an end id; documents longer than a sequence are cut
into full pieces and a rest.  Pieces are dealt by row number into buckets of about
``BUCKET_PIECES`` and each bucket is packed on its own, longest piece first: of the gaps
that hold the piece, it goes where the sum over gaps g of N(g)^2 becomes smallest, N(g)
being the number of open sequences with gap g (ties: the smallest gap).  A sequence is
opened only when no open one can take the piece.  A bucket keeps one counter per gap, so
its memory is bounded by the bucket, and a bucket wastes at most its last few gaps.

Null and empty texts give one piece that holds the end id alone; repeated rows and rows with null
ids give their own pieces; pieces of one length are placed in (doc_id, piece) order; a very long
text is cut like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import batches_of, chunks, doc_texts
from casebook.llm.token_counts import word_bpe
from casebook.llm.word_arrays import gather, slices

BUCKET_PIECES = 50_000
BUCKET = "casebook_bucket"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ``ids`` (binary, little-endian 32-bit) of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        for batch in batches_of(batches):
            for part in chunks(batch):
                flat, at, size, n = bpe.encode(part.column("text"))
                total = n + 1
                ids = np.empty(int(total.sum()), dtype="<u4")
                last = np.zeros(len(ids), dtype=bool)
                last[np.cumsum(total) - 1] = True
                ids[last], ids[~last] = end_id, gather(flat, at, size)
                k = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), k)
                piece = np.arange(len(row)) - (np.cumsum(k) - k)[row]
                start = piece * capacity
                length = np.minimum(capacity, total[row] - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)),
                     pa.array(start), pa.array(length),
                     slices(ids.view(np.uint8), 4 * np.r_[0, np.cumsum(length)]).cast(pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return doc_texts(docs).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one bucket, packed longest first."""
    seq = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    n_open = np.zeros(capacity + 1, dtype=np.int64)
    never = np.iinfo(np.int64).max
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        own = n_open[size:capacity]
        if own.any():
            # change of the sum of squares when a gap g shrinks to g - size; gap 0 counts no more
            change = np.where(own > 0, 2 * (n_open[:capacity - size] - own) + 2, never)
            if own[0]:
                change[0] = 1 - 2 * own[0]
            gap = size + int(change.argmin())
            number = open_by_gap[gap].pop()
            n_open[gap] -= 1
        else:
            gap, number = capacity, opened
            opened += 1
        seq[i], offset[i] = number, capacity - gap
        if gap > size:
            open_by_gap[gap - size].append(number)
            n_open[gap - size] += 1
    return seq, offset


def pack(items: DataFrame, capacity: int = 4096, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """``items`` (doc_id, piece, length, ...) with sequence_id and offset.

    ``items`` is read twice (count and packing): pass a staged table, whose rows also have the
    same numbers when a lost task is run again.  Buckets are dealt by these numbers, so rows
    that share an id, a null one too, spread like any others."""
    n = max(1, -(-items.count() // bucket_pieces))
    names = items.columns

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece"], kind="stable")
        seq, offset = place(part["length"].to_numpy(), capacity)
        return part[names].assign(sequence_id=(np.int64(key[0]) << 32) + seq, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    dealt = items.withColumn(BUCKET, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    return dealt.groupBy(BUCKET).applyInPandas(run, f"{schema}, sequence_id long, offset long")
