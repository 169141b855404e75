"""Exact top-k search by exhaustive term-at-a-time accumulation (operator 10).

A vector is a sparse row of integer weights, its components being the terms.  A tile of rows has
the postings of each term (row places, weights); queries that stream past scatter them with
their own weights into a dense score array, term after term; partition selection takes each
query's best rows and a window merges the blocks.  Scores are exact 64-bit integers.

Vectors that are null, empty, or hold null or non-finite components take no part; a zero
vector does (its scores are 0).  Equal scores go to the smaller vec_id; repeated rows are
candidates of their own, but never for a query with the same id.  Components must stay
below 2^31 / scale in size (sums of products are 64-bit).  An empty table gives no rows;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.vector_blocks import search, top_of_block, usable

OWN = np.iinfo(np.int64).min
QUERIES_AT_ONCE = 64


class Postings:
    """The postings of a tile of rows: per term its weights and the places where they are not 0."""

    def __init__(self, rows: np.ndarray):
        self.most = int(np.abs(rows).max(initial=0))
        self.rows = len(rows)
        small = self.most < 1 << 31
        self.columns = np.ascontiguousarray(rows.T.astype(np.int32 if small else np.int64))
        self.places = [np.flatnonzero(column) for column in self.columns]

    def scores(self, queries: np.ndarray) -> np.ndarray:
        """Scores (queries x rows): for each term, its postings times the query weights.

        A few queries at a time share a term's postings, so their score arrays stay in the cache;
        scores are 32-bit wherever the weights prove that they fit."""
        most = int(np.abs(queries).max(initial=0))
        kind = np.int32 if most * self.most * queries.shape[1] < 1 << 31 else np.int64
        queries = queries.astype(kind)
        scores = np.zeros((len(queries), self.rows), dtype=kind)
        part = np.empty((QUERIES_AT_ONCE, self.rows), dtype=kind)
        for first in range(0, len(queries), QUERIES_AT_ONCE):
            own = scores[first:first + QUERIES_AT_ONCE]
            for term, (column, places) in enumerate(zip(self.columns, self.places)):
                weights, column = queries[first:first + QUERIES_AT_ONCE, term], column.astype(kind, copy=False)
                if 2 * len(places) > len(column):        # postings of most rows: no gaps to skip
                    own += np.multiply.outer(weights, column, out=part[:len(own)])
                elif len(places):
                    own[:, places] += np.multiply.outer(weights, column[places])
        return scores.astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` largest integer inner products per query."""
    rows = usable(vectors, require_length=False).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))

    def prepare(ri, r):
        postings = Postings(r)

        def best(qi, q):
            scores = postings.scores(q)
            scores[qi[:, None] == ri[None, :]] = OWN
            a, b = top_of_block(scores, ri, k)
            s = scores[a, b]
            real = s != OWN
            return a[real], b[real], s[real]

        return best

    return search(rows, is_query, k, "long", prepare)
