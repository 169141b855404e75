"""Substring dedup by de Bruijn compaction (operator 7).

Graph: the windows of ``window`` consecutive words are the edges, the (window - 1)-word
overlaps between them the nodes.  A window is repeated when its edge has a second source
coordinate.  Counting every window would shuffle one row per word, so paths are compacted
before anything moves:

1. *Edges to paths.*  Consecutive windows of a document with the same minimizer (least hash
   of the ``anchor``-word runs inside the window) form one path, about fifteen windows in
   one row: minimizer, fingerprint of the path's words, source coordinate, length.  Equal
   windows have equal minimizers, so all places of a window meet under one minimizer.
2. *Nonbranching paths stay compact.*  Where all paths under a minimizer are the same word
   sequence there is no branch: the path is repeated as a whole or not at all.  Minimizers
   with a single place leave at the first join.
3. *Branching paths are opened.*  Under a minimizer with different paths, a path that occurs
   twice is still repeated as a whole; one place of each different path is opened into its
   single windows, which are counted (weighted by the path's count) to decide the windows
   of the paths that occur once.
4. *Source coordinates verify.*  Marks come back to their document as (start, windows,
   fingerprint); the fingerprint of the words at that place is computed again and a mark
   that doesn't hold there is refused.

Fingerprints are 64-bit and compared only under an equal minimizer hash (55 bits).  All
grouping is pre-aggregated map-side; the joins are plain equi-joins that adaptive execution
splits when a passage is hot.  Rows are told apart by a key of (doc_id, text): repeated rows
make each other's windows repeated.  Null text has no words; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.llm.common import batches_of, chunks, named, reach_workers, row_key, stage

WINDOW = 35
ANCHOR = 8
U = np.uint64
#: Odd multiplier of the rolling fingerprints, its inverse modulo 2^64, and mixing constants.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """The words of a few documents in a row, with rolling fingerprints over them."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]     # bytes.split: exactly \x20 and \x09-\x0D
        self.count = np.fromiter(map(len, self.words), dtype=np.int64, count=len(texts))
        self.first = np.cumsum(self.count) - self.count
        flat = [w for ws in self.words for w in ws]
        distinct = list(set(flat))
        place = dict(zip(distinct, range(len(distinct))))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=U, count=len(distinct))
        ids = np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat))
        n = len(flat)
        steps = np.full(n + 1, INVERSE, dtype=U)
        steps[0] = 1
        steps = np.cumprod(steps, dtype=U)
        up = np.full(n + 1, BASE, dtype=U)
        up[0] = 1
        self.up = np.cumprod(up, dtype=U)
        self.sums = np.r_[U(0), np.cumsum(hashes[ids] * steps[:n], dtype=U)] if n else np.zeros(1, U)

    def print_of(self, start: np.ndarray, length) -> np.ndarray:
        """Fingerprint of ``length`` words from flat place ``start`` on."""
        length = np.atleast_1d(length)
        return mix((self.sums[start + length] - self.sums[start]) * self.up[start]
                   ^ mix(length.astype(U)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values (shorter by width - 1)."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def paths(w: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, minimizer, fingerprint, start, windows, periodic) of each path.  A path is
    ``periodic`` if its minimizer occurs in it more than once: only then can a window repeat
    inside it."""
    empty = tuple(np.zeros(0, dtype=t) for t in (np.int64, U, U, np.int64, np.int64, bool))
    n = int(w.count.sum())
    if n < window:
        return empty
    width = window - anchor + 1
    at = np.arange(n - anchor + 1)
    low = U(511)
    high = w.print_of(at, anchor) & ~low
    place = at.astype(U) & low
    first = sliding_min(high | place, width)          # the minimizer and its first place
    last = sliding_min(high | (low - place), width)   # the minimizer and its last place
    mini = first >> U(9)
    at = np.arange(len(mini))
    doc = np.repeat(np.arange(len(w.count)), w.count)[:len(mini)]
    inside = at + window <= (w.first + w.count)[doc]
    begins = inside & np.r_[True, ~inside[:-1] | (mini[1:] != mini[:-1]) | (doc[1:] != doc[:-1])]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return empty
    run = np.cumsum(begins) - 1
    size = np.bincount(run[inside], minlength=len(starts))
    moved = inside & ((first & low) != low - (last & low))
    moved |= inside & ~begins & np.r_[False, first[1:] != first[:-1]]
    periodic = np.bincount(run[moved], minlength=len(starts)) > 0
    return (doc[starts], mini[starts], w.print_of(starts, size + window - 1),
            starts - w.first[doc[starts]], size, periodic)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64))


def _tag(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """One row per path of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for part in chunks(batch):
                doc, mini, print_, start, size, periodic = paths(
                    Words(part.column("text").to_pylist()), window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(doc)), _long(mini), _long(print_),
                     pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)),
                     pa.array(periodic)],
                    names=["key", "mini", "print", "start", "size", "periodic"])

    return texts.select("key", "text").mapInArrow(
        run, "key long, mini long, print long, start int, size int, periodic boolean")


def _open(held: DataFrame, window: int) -> DataFrame:
    """Single windows of the listed paths: ``held`` has key, text, list (start, size, n, mini)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for part in chunks(batch):
                w = Words(part.column("text").to_pylist())
                lists = part.column("list")
                per_doc = lists.value_lengths().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), per_doc)
                item = {n: lists.flatten().field(i).to_numpy(zero_copy_only=False)
                        for i, n in enumerate(("start", "size", "n", "mini"))}
                which = np.repeat(np.arange(len(doc)), item["size"])
                step = np.arange(len(which)) - np.repeat(
                    np.cumsum(item["size"]) - item["size"], item["size"])
                own = item["start"][which] + step
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(doc[which])), pa.array(item["mini"][which]),
                     _long(w.print_of(w.first[doc[which]] + own, window)),
                     pa.array(own.astype(np.int32)), pa.array(item["n"][which])],
                    names=["key", "mini", "print", "start", "n"])

    return held.select("key", "text", "list").mapInArrow(
        run, "key long, mini long, print long, start int, n long")


def _cut(held: DataFrame, window: int, keep_layout: bool) -> DataFrame:
    """Verify the marks (start, size, print) of each document and remove what they cover."""
    own_columns = [c for c in held.columns if c not in ("text", "list")]
    schema = T.StructType([f for f in held.schema if f.name in own_columns]
                          + T.StructType.fromDDL("n_words long, n_removed long, kept binary, "
                                                 "spans array<struct<first:int,after:int>>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for part in chunks(batch):
                texts = part.column("text").to_pylist()
                w = Words(texts)
                lists = part.column("list")
                per_doc = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), per_doc)
                items = lists.flatten()
                start, size, mark = (items.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                words = size.astype(np.int64) + window - 1
                holds = start + words <= w.count[doc]
                at = np.where(holds, w.first[doc] + start, 0)
                words = np.where(holds, words, 0)
                holds &= w.print_of(at, words) == mark.view(U)
                edge = np.zeros(len(w.up), dtype=np.int64)
                np.add.at(edge, at[holds], 1)
                np.add.at(edge, (at + words)[holds], -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed, kept, spans = [], [], []
                for i, ws in enumerate(w.words):
                    own = gone[w.first[i]:w.first[i] + len(ws)]
                    turns = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                    removed.append(int(own.sum()))
                    spans.append([{"first": int(a), "after": int(b)}
                                  for a, b in zip(turns[::2], turns[1::2])])
                    if len(turns):
                        kept.append(b" ".join([x for x, g in zip(ws, own.tolist()) if not g]))
                    else:
                        kept.append(texts[i] if keep_layout else b" ".join(ws))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in own_columns), pa.array(w.count),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.binary()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())])))],
                    names=[*own_columns, "n_words", "n_removed", "kept", "spans"])

    return held.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR,
                   carry: tuple[str, ...] = (), keep_layout: bool = False) -> DataFrame:
    """doc_id, key, n_words, n_removed, kept (remaining words, one space between, UTF-8) and
    spans (removed word ranges) of every document; ``key`` tells rows apart (``row_key``).
    ``carry`` names input columns to bring along, in a struct ``carried``; with ``keep_layout``
    a text that loses nothing is kept as it was, white space included."""
    reach_workers(docs.sparkSession)
    texts = docs.select("doc_id", row_key().alias("key"),
                        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
                        *([F.struct(*map(named, carry)).alias("carried")] if carry else []))
    tagged = stage(_tag(texts, window, anchor))
    # minimizers that can hold a repeated window, and whether their paths branch
    shared = (tagged.groupBy("mini")
              .agg(F.count(F.lit(1)).alias("places"), F.min("print").alias("lo"),
                   F.max("print").alias("hi"), F.bool_or("periodic").alias("periodic"))
              .where((F.col("places") > 1) | F.col("periodic"))
              .select("mini", ((F.col("lo") == F.col("hi")) & ~F.col("periodic")).alias("plain")))
    places = stage(tagged.select("key", "mini", "print", "start", "size").join(shared, "mini"))
    branching = places.where(~F.col("plain"))
    kinds = branching.groupBy("mini", "print").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "size")).alias("at"))
    whole = (places.where("plain").select("key", "start", "size", "print")
             .unionByName(branching.join(kinds.where("n > 1").select("mini", "print"),
                                         ["mini", "print"])
                          .select("key", "start", "size", "print")))
    to_open = (kinds.select("at.key", F.struct("at.start", "at.size", "n", "mini").alias("x"))
               .groupBy("key").agg(F.collect_list("x").alias("list")))
    # a repeated row opens its paths again; they occur twice, so no count is changed by it
    windows = stage(_open(texts.select("key", "text").join(to_open, "key"), window))
    twice = (windows.groupBy("mini", "print").agg(F.sum("n").alias("total"))
             .where("total > 1").select("mini", "print"))
    single = (windows.where("n = 1").join(twice, ["mini", "print"])
              .select("key", "start", F.lit(1).alias("size"), "print"))
    # repeated rows share a key and carry the same marks: each is kept once, map-side already,
    # so a list is bounded by its own text
    marks = (whole.unionByName(single)
             .groupBy("key").agg(F.collect_set(F.struct("start", "size", "print")).alias("list")))
    return _cut(texts.join(marks, "key", "left"), window, keep_layout)
