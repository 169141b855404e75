"""Queries streamed past blocks of all vectors, shared by the vector searches.

Every row is dealt into one block and held there once; the queries are sent to every block and
go past it in Arrow batches, tile by tile, so a task's memory is its block and one batch.  A
block gives its best few rows per query and a ranked window merges the blocks.  Blocks are
dealt by row number: equal ids or vectors do not pile up.

At n rows and q queries, n rows and q * n / ``ROW_BLOCK`` queries are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import batches_of, reach_workers

#: Rows of a block at most (there are two blocks per core at least), and of a tile of scores.
ROW_BLOCK, ROW_TILE, QUERY_TILE = 65_536, 4096, 512


def usable(vectors: DataFrame, require_length: bool) -> DataFrame:
    """vec_id and v (array<double>) of rows whose id and vector take part: no null id, no null
    or empty vector, no null or non-finite component; with ``require_length`` no zero vector."""
    reach_workers(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & good)
    return rows.where(F.exists("v", lambda x: x != 0)) if require_length else rows


class _Block:
    """The rows of one block and one length, in tiles, as they come in ascending ids."""

    def __init__(self, prepare, tile: int):
        self.prepare, self.tile = prepare, tile
        self.ids: list = []
        self.vectors: list = []
        self.tiles: list | None = None

    def hold(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)

    def best(self, qi: np.ndarray, q: np.ndarray, k: int):
        """(query id, row id, score) of the k best rows per query."""
        if self.tiles is None:
            ids, vectors = np.concatenate(self.ids), np.concatenate(self.vectors)
            self.ids, self.vectors = [], []
            self.tiles = [(ids[a:a + self.tile], self.prepare(ids[a:a + self.tile], vectors[a:a + self.tile]))
                          for a in range(0, len(ids), self.tile)]
        found = []
        for ids, ask in self.tiles:
            a, b, s = ask(qi, q)
            found.append((a, ids[b], s))
        a, ids, s = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, -s, a))
        a = a[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        return qi[a[keep]], ids[order][keep], s[order][keep]


def search(rows: DataFrame, is_query: Column, k: int, score_type: str,
           prepare: Callable[[np.ndarray, np.ndarray], Callable], row_block: int = ROW_BLOCK,
           row_tile: int = ROW_TILE, query_tile: int = QUERY_TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of each query.

    ``prepare(row ids, row matrix)`` of a tile (ids ascending) returns a function of (query ids,
    query matrix) that gives parallel arrays (query place, row place, score): at least the ``k``
    best rows of the tile for each query by (score descending, vec_id ascending), the query's
    own id left out.  Vectors of different length never meet.  Repeated ids are rows of their own;
    a query id that occurs more than once is asked once (its lexicographically smallest vector)."""
    blocks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // row_block))
    dim = F.size("v").alias("dim")
    held = rows.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"),
                       dim, F.lit(False).alias("asks"), "vec_id", "v")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    posed = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), dim,
                         F.lit(True).alias("asks"), "vec_id", "v")
    dealt = (held.unionByName(posed).repartition(blocks, "block")
             .sortWithinPartitions("block", "dim", "asks", "vec_id"))
    kind = {"long": pa.int64(), "double": pa.float64()}[score_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches_of(batches):
            if not batch.num_rows:
                continue
            numbers, dims, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False)
                                        for c in ("block", "dim", "asks", "vec_id"))
            turn = (np.diff(numbers) != 0) | (np.diff(dims) != 0) | (asks[1:] != asks[:-1])
            cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if (numbers[a], dims[a]) != key:
                    key, block = (numbers[a], dims[a]), _Block(prepare, row_tile)
                vectors = batch.column("v").slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                vectors = vectors.reshape(b - a, dims[a])
                if not asks[a]:
                    block.hold(ids[a:b], vectors)
                elif block.ids or block.tiles:
                    for at in range(0, b - a, query_tile):
                        own = slice(a + at, min(a + at + query_tile, b))
                        q, v, score = block.best(ids[own], vectors[at:at + query_tile], k)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(score, kind)],
                            names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top_of_block(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query place, row place) of the ``k`` best scores per row of ``scores``; ``ids`` are
    ascending, so equal scores go to the smaller id.  Partition selection finds the k-th score
    and everything at or above it is ranked, so ties at the edge are decided exactly."""
    n = scores.shape[1]
    if n > k:
        kth = np.partition(scores, n - k, axis=1)[:, n - k]
        a, b = np.nonzero(scores >= kth[:, None])
    else:
        a, b = np.nonzero(np.ones(scores.shape, dtype=bool))
    order = np.lexsort((b, -scores[a, b], a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], b[place < k]
