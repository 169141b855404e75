"""Interaction of document filters, from a sparse document-term matrix (operator 13).

Words are encoded by one global dictionary.  A map task first builds a shard of about
``SHARD_BYTES`` of text with a dictionary of its own: distinct words once, and per document
row the columns and counts of its words (compressed sparse rows, packed).  The shards' words are dealt into buckets by hash; a bucket's task numbers its
words, and each shard gets the global numbers of its columns back, so words travel once per
shard and not once per document, packed and not one per row.  A shard's columns stand in
hash order, so a bucket gets a stretch of them and its answer needs no places.  From the finished shards the row
sums (words) and the numbers of stored columns (distinct words) decide filters A and B.  C and D
are flags of the characters, taken while the shard is built; E compares digests of the texts.

Each document ends as one set of failed filters.  Sets are counted per partition, with the
labels, before anything is multiplied by the 120 orders of the filters.

Null texts count as empty; an empty text fails A alone (and E, if another is empty too).  A null
id is never smaller than another, and no id is smaller than it.  Repeated rows count each; a
repeated id is not smaller than itself.  A null partition counts under the empty string.
Several labels of one id count as 1 if any is 1; a null label is 0.  A very long text is a shard
of its own.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import batches_of, chunks, doc_texts, stage
from casebook.llm.word_arrays import TextBytes, gather, word_array

SHARD_BYTES = 4 << 20
#: (shard, word) pairs that one bucket of the dictionary gets, about; its task holds its distinct words.
BUCKET_WORDS = 500_000
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SPECIAL = b"#$%&*|"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT = 100, 80, 10


def _flag_table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(characters)] = True
    return table


CAPITAL, MARK = _flag_table(bytes(range(ord("A"), ord("Z") + 1))), _flag_table(SPECIAL)
#: The first byte of each code point.
LEADING = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<i4").tobytes()


def _unpacked(raw) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i4")


def _columns(values: np.ndarray, words: int) -> bytes:
    """Column numbers below ``words``, in three bytes each where that is enough."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return (raw[:, :3] if words <= 1 << 24 else raw).tobytes()


def columns_of(raw, words: int) -> np.ndarray:
    if words > 1 << 24:
        return np.frombuffer(raw, dtype="<u4")
    part = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
    out = np.zeros((len(part), 4), dtype=np.uint8)
    out[:, :3] = part
    return out.view("<u4").ravel()


def _counts(values: np.ndarray) -> bytes:
    """Counts (from 1), in one byte each where all fit; ``counts_of`` tells by the length."""
    return values.astype("u1" if len(values) and values.max() < 256 else "<i4").tobytes()


def counts_of(raw, cells: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="u1" if len(raw) == cells else "<i4")


#: Weights of a word's bytes by place (they repeat in longer words) in the hash that deals words out.
WEIGHTS = np.random.default_rng(13).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """32-bit hash of each word data[start:start + size] (words follow each other without a gap)."""
    place = np.arange(len(data)) - np.repeat(start, size)
    value = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * WEIGHTS[place % len(WEIGHTS)], start)
    return ((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


def _dictionary(values: pa.Array) -> tuple[np.ndarray, bytes]:
    """(place of each distinct word in hash order; the words in that order, each ended by a blank)."""
    if not len(values):
        return np.zeros(0, dtype=np.int64), b""
    values = values.cast(pa.large_binary())
    cuts = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset:values.offset + len(values) + 1]
    data, cuts = np.frombuffer(values.buffers()[2], dtype=np.uint8)[cuts[0]:cuts[-1]], cuts - cuts[0]
    size = np.diff(cuts)
    order = np.argsort(_hashes(data, cuts[:-1], size), kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    ends = np.cumsum(size[order] + 1)
    out = np.full(int(ends[-1]), ord(" "), dtype=np.uint8)
    shown = np.ones(len(out), dtype=bool)
    shown[ends - 1] = False
    out[shown] = gather(data, cuts[:-1][order], size[order])
    return place, out.tobytes()


def shards(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, part, digest) as shards with local dictionaries: shard, the rows'
    doc_id, part, digest, c and d (arrays), and the matrix: row_words (columns stored per row),
    cols, counts (packed); words is the local dictionary of n_words words, each one ended by a blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches_of(batches):
            for part in chunks(batch, max_bytes=SHARD_BYTES):
                text = TextBytes(part.column("text"))
                words, row = word_array(text)
                coded = words.dictionary_encode()
                # one key per (row, column), sorted: the matrix in row order
                place, dictionary = _dictionary(coded.dictionary)
                cell, n = np.unique(row << 32 | place[coded.indices.to_numpy()], return_counts=True)
                rows = part.num_rows
                per_row = np.bincount(cell >> 32, minlength=rows)
                capitals, points = text.count(CAPITAL), text.count(LEADING)
                flags = [pa.array(100 * capitals > MAX_CAPITALS_PCT * points), pa.array(text.count(MARK) > 0)]

                def row_list(values):
                    return pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), values)

                packed = [_packed(per_row), _columns(cell & 0xFFFFFFFF, len(place)), _counts(n), dictionary]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), *[row_list(part.column(c)) for c in ("doc_id", "part", "digest")],
                     *map(row_list, flags), *[pa.array([x], pa.binary()) for x in packed],
                     pa.array([len(place)], pa.int64())],
                    names=["shard", "doc_id", "part", "digest", "c", "d", "row_words", "cols", "counts", "words",
                           "n_words"])
                shard += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"shard long, doc_id array<{kind}>, part array<string>, digest array<binary>, "
                                "c array<boolean>, d array<boolean>, row_words binary, cols binary, "
                                "counts binary, words binary, n_words long")


def _deal(dictionaries: DataFrame, buckets: int) -> DataFrame:
    """(shard, words) as one row per shard and bucket: bucket, shard, first (place of the first word in
    the shard's dictionary) and words.  A bucket is a range of hashes, a stretch of each dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for shard, words in zip(batch.column("shard").to_pylist(), batch.column("words")):
                raw = words.as_buffer()
                data = np.frombuffer(raw, dtype=np.uint8)
                if not len(data):
                    continue
                end = np.flatnonzero(data == ord(" ")) + 1
                start = np.r_[0, end[:-1]]
                shown = data != ord(" ")
                size = end - start - 1
                value = _hashes(data[shown], np.cumsum(size) - size, size)
                bucket = (value * np.uint64(buckets)) >> np.uint64(32)
                first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                at = [*start[first].tolist(), len(data)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[first].astype(np.int64)), pa.array(np.full(len(first), shard)),
                     pa.array(first), pa.array([raw[a:b].to_pybytes() for a, b in zip(at[:-1], at[1:])], pa.binary())],
                    names=["bucket", "shard", "first", "words"])

    return dictionaries.select("shard", "words").mapInArrow(
        run, "bucket long, shard long, first long, words binary")


def _number(dealt: DataFrame) -> DataFrame:
    """shard, first, base and ids (packed): the global number of a word is its task's base plus its
    place in the task's dictionary.  All rows of a bucket must be in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, known = TaskContext.get().partitionId() << 32, {}
        for batch in batches_of(batches):
            ids = [_packed(np.array([known.setdefault(w, len(known)) for w in words.as_py().split()]))
                   for words in batch.column("words")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("first"), pa.array([base] * len(ids), pa.int64()),
                 pa.array(ids, pa.binary())], names=["shard", "first", "base", "ids"])

    return dealt.select("shard", "first", "words").mapInArrow(run, "shard long, first long, base long, ids binary")


def matrix(docs: DataFrame) -> DataFrame:
    """The document-term matrix as shards whose columns have global numbers: ``column_ids`` lists
    (first, base, ids) of stretches of the local columns."""
    local = stage(shards(docs))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    total = local.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(2 * cores, -(-total // BUCKET_WORDS))
    ids = _number(_deal(local, buckets).repartition(buckets, "bucket"))
    # a shard without words has no row in ids
    return local.drop("words").join(
        ids.groupBy("shard").agg(F.collect_list(F.struct("first", "base", "ids")).alias("column_ids")), "shard", "left")


def global_columns(n_words: int, column_ids) -> np.ndarray:
    """Global number of each local column of a shard."""
    out = np.zeros(n_words, dtype=np.int64)
    for some in column_ids or []:
        ids = _unpacked(some["ids"])
        out[some["first"]:some["first"] + len(ids)] = ids.astype(np.int64) + some["base"]
    return out


def row_flags(finished: DataFrame) -> DataFrame:
    """doc_id, part, digest and the flags a to d of each document, read off the matrix: row
    sums are word counts, stored columns are distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for i in range(batch.num_rows):
                one = {name: batch.column(name)[i] for name in batch.schema.names}
                n_words = one["n_words"].as_py()
                columns = global_columns(n_words, one["column_ids"].as_py())
                cols, per_row = columns_of(one["cols"].as_buffer(), n_words), _unpacked(one["row_words"].as_buffer())
                columns, counts = columns[cols], counts_of(one["counts"].as_buffer(), len(cols))
                start = np.r_[0, np.cumsum(per_row, dtype=np.int64)]
                sums = np.r_[0, np.cumsum(counts, dtype=np.int64)]
                words = sums[start[1:]] - sums[start[:-1]]
                # stored columns of a row, each with a number of its own
                distinct = np.bincount(np.repeat(np.arange(len(per_row)), per_row)[columns >= 0],
                                       minlength=len(per_row))
                yield pa.RecordBatch.from_arrays(
                    [*(one[c].values for c in ("doc_id", "part", "digest")), pa.array(words < MIN_WORDS),
                     pa.array(100 * distinct < MIN_DISTINCT_PCT * words), one["c"].values, one["d"].values],
                    names=["doc_id", "part", "digest", "a", "b", "c", "d"])

    kind = finished.schema["doc_id"].dataType.elementType.simpleString()
    return finished.mapInArrow(
        run, f"doc_id {kind}, part string, digest binary, a boolean, b boolean, c boolean, d boolean")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and ``failed`` (the letters of the filters a document fails) per document."""
    texts = doc_texts(docs, "lang").select(
        "doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2("text", 256)).alias("digest"))
    flags = stage(row_flags(matrix(texts)))
    # one row per text that several ids share
    first = (flags.groupBy(F.col("digest").alias("text_digest"))
             .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
             .where("most > least").select("text_digest", "least"))
    joined = flags.join(first, F.col("digest") == F.col("text_digest"), "left")
    e = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return joined.select("doc_id", "part", F.concat(*[
        F.when(flag, F.lit(letter)).otherwise(F.lit(""))
        for letter, flag in zip(FILTERS, [F.col("a"), F.col("b"), F.col("c"), F.col("d"), e])]).alias("failed"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per part, filter order and step."""
    failed = failures(docs)
    marks = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    # rows without an id have no label and stay out of the join, where they would meet in one task
    known = failed.where("doc_id IS NOT NULL").join(marks, F.col("doc_id") == F.col("label_id"), "left")
    rest = failed.where("doc_id IS NULL").select("*", *[F.lit(None).alias(c) for c in ("label_id", "good", "toxic")])
    sets = (known.union(rest).groupBy("part", "failed")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"),
                 F.count_if("toxic").alias("n_toxic")))
    at = sets.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select(
        "*", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])).alias("step"))
    at = at.select("*", F.expr("substring(filter_order, step, 1)").alias("letter"),
                   F.expr("length(translate(substring(filter_order, 1, step - 1), failed, '')) < step - 1")
                   .alias("gone"))
    at = at.withColumn("fails", F.expr("instr(failed, letter) > 0"))

    def count(condition: str, column: str = "n"):
        return F.sum(F.when(F.expr(condition), F.col(column)).otherwise(F.lit(0).cast("long")))

    steps = at.groupBy("part", "filter_order", "step", "letter").agg(
        count("NOT gone AND NOT fails").alias("kept"), count("NOT gone AND fails").alias("removed"),
        count("gone AND fails").alias("redundant"), count("failed = letter").alias("unique_fails"),
        count("NOT gone AND fails", "n_good").alias("good_lost"),
        count("NOT gone AND fails", "n_toxic").alias("toxic_lost"))
    share = (at.groupBy(F.col("part").alias("share_part"), F.col("letter").alias("share_letter"))
             .agg(count("NOT gone AND fails").alias("shapley")))
    return (steps.join(share, (F.col("part") == F.col("share_part")) & (F.col("letter") == F.col("share_letter")))
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                    "good_lost", "toxic_lost", "shapley"))
