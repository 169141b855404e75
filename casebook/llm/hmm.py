"""Hidden Markov language model (operator 2).

Words are counted over all training texts (partial counts in each task, one shuffle).  The
model's symbols are classes: the end token, the ``CLASS_WORDS`` commonest words one by one,
and every other word by the hash of its last three bytes into ``SUFFIXES`` classes, within
which a word has its smoothed share and one share is kept for unknown words - so the model
is a proper distribution over all texts and its tables are bounded whatever the vocabulary.

*Training*: Baum-Welch.  Each task runs scaled forward-backward over its texts (sorted by
length, side by side in numpy) and returns expected counts per class and state; Spark sums
them over tasks; the driver keeps the bounded tables only.  States start from the class
shares, tilted at random per word ending.

*Scoring*: the scaled forward recursion in double precision gives the exact likelihood of
the class sequence.  A word's share within its class does not depend on the state, so it
is a factor outside the recursion: counts of the ``VOCAB_WORDS`` commonest words (of at
most ``WORD_BYTES`` bytes: a bounded broadcast) are looked up in the task, all other words
are joined with the count table by word.

All texts are read whole, twice: once to count, once to be turned into classes, which are
staged (two bytes a token) for the training rounds and the scoring.  Null and empty texts are the end token alone.
Repeated rows are scored alike and count twice in training.  Without training texts every
word is unknown and the model is uniform.  An empty table gives no rows; a very long text goes
through the recursion whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import batches_of, chunks, ragged, reach_workers, row_key, stage
from casebook.llm.word_arrays import TextBytes, byte_strings, word_array

STATES = 8
#: Training ends when a round gains less than TOLERANCE (nats a token), after ROUNDS rounds at the latest.
ROUNDS, TOLERANCE = 30, 0.06
#: Text whose words are counted together.
COUNT_BYTES = 4 << 20
CLASS_WORDS = 1 << 14
SUFFIXES = 1 << 10
VOCAB_WORDS = 1 << 18
WORD_BYTES = 64
#: Tokens that go through the recursion together in one task.
BLOCK_TOKENS = 500_000
COUNT_CAP = 1 << 16
SMOOTH = 0.1
PRIOR = 30.0


def suffix_class(word: bytes) -> int:
    return 1 + CLASS_WORDS + zlib.crc32(word[-3:]) % SUFFIXES


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", row_key().alias("key"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts; the words of a chunk are counted together by array work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for part in chunks(batch, max_bytes=COUNT_BYTES):
                words, _ = word_array(TextBytes(part.column("text"), lower=True))
                seen = words.value_counts()
                yield pa.RecordBatch.from_arrays(
                    [seen.field("values").cast(pa.binary()), seen.field("counts")], names=["word", "n"])

    return (texts.select("text").mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


class Vocabulary:
    """Counts and classes of the words that tasks know without a join."""

    def __init__(self, blob: bytes, sizes: np.ndarray, counts: np.ndarray, classes: np.ndarray,
                 class_mass: np.ndarray):
        cuts = np.r_[0, np.cumsum(sizes)].tolist()
        self.place = {blob[a:b]: i for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))}
        self.counts, self.classes, self.class_mass = counts, classes, class_mass

    def encode(self, column: pa.Array):
        """Flat places in the vocabulary (-1: elsewhere) and classes, an end (place -2, class 0)
        after each text; tokens per text; the words that are elsewhere: (text, word, its number
        in the text), as arrays.  A distinct word of the column is looked up once."""
        words, row = word_array(TextBytes(column, lower=True))
        n = np.bincount(row, minlength=len(column)) + 1
        coded = words.dictionary_encode()
        own, index = byte_strings(coded.dictionary), coded.indices.to_numpy()
        found = np.fromiter(map(self.place.get, own, repeat(-1)), dtype=np.int64, count=len(own))
        kind = np.zeros(len(own), dtype=np.int64)
        if len(self.classes):
            kind = np.where(found >= 0, self.classes[np.maximum(found, 0)], 0)
        rare = np.flatnonzero(found < 0)
        kind[rare] = [suffix_class(own[i]) for i in rare.tolist()]
        inner = np.ones(int(n.sum()), dtype=bool)
        inner[np.cumsum(n) - 1] = False
        place = np.full(len(inner), -2, dtype=np.int64)
        place[inner] = found[index]
        classes = np.zeros(len(inner), dtype=np.int64)
        classes[inner] = kind[index]
        beyond = found[index] < 0
        cell, times = np.unique(row[beyond] << 32 | index[beyond], return_counts=True)
        return place, classes, n, (cell >> 32, coded.dictionary.take(pa.array(cell & 0xFFFFFFFF)), times)


_KNOWN: dict = {}


def _vocabulary(shared) -> Vocabulary:
    """The broadcast vocabulary (tag, parts) as a dictionary, built once per worker."""
    tag, *parts = shared.value
    if tag not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[tag] = Vocabulary(*parts)
    return _KNOWN[tag]


def by_length(classes: pa.Array, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row places, classes one text after the other, lengths) in blocks of about ``block``
    tokens of texts of similar length, longest first; a text is never cut."""
    n = classes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(n):
        return
    flat = classes.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    group = np.cumsum(n[order]) // block
    for own in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        size = n[own]
        at = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        yield own, flat[at].astype(np.int64), size


class Lattice:
    """Sequences side by side: token t of all sequences longer than t lies in one stretch."""

    def __init__(self, n: np.ndarray):
        self.order = np.argsort(-n, kind="stable")
        size = n[self.order]
        self.active = len(n) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")
        self.offset = np.r_[0, np.cumsum(self.active)]
        first = np.cumsum(n) - n
        rank = np.empty(len(n), dtype=np.int64)
        rank[self.order] = np.arange(len(n))
        t = np.arange(int(n.sum())) - np.repeat(first, n)
        self.slot = self.offset[t] + np.repeat(rank, n)      # doc-major token -> stretch-major

    def forward(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """Scaled forward variables and scale factors, in stretch order."""
        alpha = np.empty_like(emit)
        scale = np.empty(len(emit), dtype=emit.dtype)
        now = np.broadcast_to(start, (len(self.order), len(start)))
        for t, n in enumerate(self.active.tolist()):
            a = self.offset[t]
            now = (now if t == 0 else now[:n] @ move) * emit[a:a + n]
            c = now.sum(axis=1)
            now /= c[:, None]
            alpha[a:a + n] = now
            scale[a:a + n] = c
        return alpha, scale

    def backward(self, move: np.ndarray, emit: np.ndarray, scale: np.ndarray):
        """Scaled backward variables, and emission * backward / scale, in stretch order."""
        beta = np.ones_like(emit)
        pull = np.empty_like(emit)
        back = move.T.copy()
        for t in range(len(self.active) - 1, -1, -1):
            a, n = self.offset[t], self.active[t]
            own = emit[a:a + n] * beta[a:a + n]
            own /= scale[a:a + n, None]
            pull[a:a + n] = own
            if t:
                before = self.offset[t - 1]
                beta[before:before + n] = own @ back
        return beta, pull

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of stretch-ordered values per sequence, in the sequences' own order."""
        out = np.zeros(len(self.order))
        for t, n in enumerate(self.active.tolist()):
            a = self.offset[t]
            out[:n] += values[a:a + n]
        per = np.empty_like(out)
        per[self.order] = out
        return per


def expected_counts(n, classes, model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of one block: start, moves, emissions (class x state), log likelihood."""
    start, move, emit_table = (x.astype(np.float32) for x in model)
    grid = Lattice(n)
    symbol = np.empty(len(classes), dtype=np.int64)
    symbol[grid.slot] = classes
    emit = emit_table[symbol]
    alpha, scale = grid.forward(start, move, emit)
    beta, pull = grid.backward(move, emit, scale)
    beta *= alpha                                        # state posteriors
    states = len(start)
    emitted = np.stack([np.bincount(symbol, beta[:, k], minlength=len(emit_table))
                        for k in range(states)], axis=1)
    started = beta[:grid.active[0]].sum(axis=0, dtype=np.float64)
    # token (t, r) is followed by (t + 1, r): the first active[t + 1] tokens of stretch t
    follow = np.arange(grid.offset[1], len(emit))
    rank = follow - np.repeat(grid.offset[1:-1], grid.active[1:])
    lead = np.repeat(grid.offset[:-2], grid.active[1:]) + rank
    moved = (alpha[lead].T @ pull[follow]).astype(np.float64) * move
    return started, moved, emitted, float(np.log(scale.astype(np.float64)).sum())


class Model:
    """Start, move and emission tables with the class shares they are smoothed by."""

    def __init__(self, class_mass: np.ndarray, endings: np.ndarray, states: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.base = (class_mass + 0.5) / (class_mass + 0.5).sum()
        tilt = rng.normal(0, 0.7, (SUFFIXES, states))[endings] + rng.normal(0, 0.2, (len(endings), states))
        emit = self.base[:, None] * np.exp(tilt)
        emit[0] = self.base[0]
        self.emit = emit / emit.sum(axis=0)
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.05 / (states - 1)) if states > 1 else np.ones((1, 1))
        if states > 1:
            np.fill_diagonal(self.move, 0.95)

    def tables(self):
        return self.start, self.move, self.emit

    def update(self, start, move, emit) -> None:
        self.start = (start + 1) / (start + 1).sum()
        self.move = (move + 0.5) / (move + 0.5).sum(axis=1, keepdims=True)
        self.emit = (emit + PRIOR * self.base[:, None]) / (emit.sum(axis=0) + PRIOR)


def _expectation(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts over all training texts (their classes) and their log likelihood, summed by
    Spark per class."""
    spark = train.sparkSession
    states, n_classes = len(model.start), len(model.emit)
    tables = spark.sparkContext.broadcast(model.tables())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n_classes + states + 2, states))   # emissions, moves, start, log likelihood
        for batch in batches_of(batches):
            for _, classes, n in by_length(batch.column("classes"), BLOCK_TOKENS):
                started, moved, emitted, log = expected_counts(n, classes, tables.value)
                total[:n_classes] += emitted
                total[n_classes:-2] += moved
                total[-2] += started
                total[-1] += log
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), *(pa.array(total[some, k]) for k in range(states))],
            names=["row", *(f"s{k}" for k in range(states))])

    columns = [f"s{k}" for k in range(states)]
    summed = (train.select("classes")
              .mapInArrow(run, "row int, " + ", ".join(f"{c} double" for c in columns))
              .groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toPandas())
    total = np.zeros((n_classes + states + 2, states))
    total[summed["row"].to_numpy()] = summed[columns].to_numpy()
    tables.unpersist()
    return total[-2], total[n_classes:-2], total[:n_classes], float(total[-1, 0])


def _encoded(docs: DataFrame, held_out: Column, shared, ends: int, spread: np.ndarray) -> DataFrame:
    """One row per text: its classes; how many tokens are known and the sum of their log10
    smoothed counts (``weight``), and of their shares within their classes (``share``), as far
    as the broadcast words go; the words beyond them with their numbers (``rare``)."""
    rows = docs.select("doc_id", row_key().alias("key"), held_out.alias("held_out"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _vocabulary(shared)
        for batch in batches_of(batches):
            for part in chunks(batch):
                place, classes, n, (where, rare, times) = known.encode(part.column("text"))
                first = np.cumsum(n) - n
                c = np.zeros(len(place))
                if len(known.counts):
                    c = np.where(place >= 0, known.counts[np.maximum(place, 0)], 0)
                c = np.where(place == -2, ends, c)
                there = place != -1
                weight = np.where(there, np.log10(c + SMOOTH), 0.0)
                share = np.where(classes > CLASS_WORDS, weight - spread[classes], 0.0)
                words = pa.StructArray.from_arrays([rare.cast(pa.binary()), pa.array(times, pa.int64())],
                                                   names=["word", "n"])
                cuts = np.searchsorted(where, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), part.column("held_out"),
                     ragged(classes.astype(np.int16), n, pa.int16()),
                     pa.array(np.add.reduceat((there & (c > 0)).astype(np.int64), first)),
                     pa.array(np.add.reduceat(weight, first)), pa.array(np.add.reduceat(share, first)),
                     pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words)],
                    names=["doc_id", "key", "held_out", "classes", "known", "weight", "share", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, key long, held_out boolean, classes array<smallint>, known long, "
             "weight double, share double, rare array<struct<word:binary,n:long>>")


def _forward(encoded: DataFrame, model: Model) -> DataFrame:
    """doc_id, key, held_out, n_tokens, known, weight, total: the log10 likelihood of the class
    sequence by the scaled forward recursion, plus the words' shares."""
    tables = encoded.sparkSession.sparkContext.broadcast(model.tables())
    names = ["doc_id", "key", "held_out", "n_tokens", "known", "weight", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit_table = tables.value
        for batch in batches_of(batches):
            share = batch.column("share").to_numpy()
            for rows, classes, n in by_length(batch.column("classes"), BLOCK_TOKENS // 2):
                grid = Lattice(n)
                symbol = np.empty(len(classes), dtype=np.int64)
                symbol[grid.slot] = classes
                _, scale = grid.forward(start, move, emit_table[symbol])
                place = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(place) for c in names[:3]), pa.array(n),
                     *(batch.column(c).take(place) for c in names[4:6]),
                     pa.array(grid.sums(np.log10(scale)) + share[rows])], names=names)

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.drop("rare").mapInArrow(
        run, f"doc_id {kind}, key long, held_out boolean, n_tokens long, known long, weight double, "
             "total double")


def train_model(train: DataFrame, model: Model, tokens: int, rounds: int, tolerance: float) -> list[float]:
    """Baum-Welch rounds on staged classes until one gains less than ``tolerance`` (nats a token), at
    most ``rounds``; returns the log likelihood a token that each round started from."""
    seen: list[float] = []
    for _ in range(rounds):
        *counts, log = _expectation(train, model)
        seen.append(log / max(tokens, 1))
        model.update(*counts)
        if len(seen) > 1 and seen[-1] - seen[-2] < tolerance:
            break
    return seen


def score(docs: DataFrame, held_out: Column, states: int = STATES, rounds: int = ROUNDS,
          tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every
    text; texts with ``held_out`` false are the training texts."""
    spark = docs.sparkSession
    reach_workers(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    train = _texts(docs.where(~held_out))
    counts = stage(count_words(train))
    size = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = train.count()
    n_all, distinct = size["n"] + ends, size["v"] + (ends > 0)

    # the commonest words, by a threshold on the count: every count up to COUNT_CAP is a level, above
    # it every power of two, so that some COUNT_CAP rows reach the driver and no level is large
    short = counts.where(F.octet_length("word") <= WORD_BYTES)
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n") / F.lit(COUNT_CAP)))).cast("long")
    level = F.when(F.col("n") < COUNT_CAP, F.col("n")).otherwise(F.lit(COUNT_CAP) * power)
    levels = sorted(((r["c"], r["k"]) for r in short.groupBy(level.alias("c"))
                     .agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, room = 1 << 62, VOCAB_WORDS
    for c, k in levels:
        if k > room:
            break
        least, room = c, room - k
    held = short.where(F.col("n") >= least).toArrow()     # at most VOCAB_WORDS rows
    common = sorted(zip(held.column("n").to_pylist(), held.column("word").to_pylist()),
                    key=lambda x: (-x[0], x[1]))
    listed = [w for _, w in common]
    classes = np.array([1 + i if i < CLASS_WORDS else suffix_class(w) for i, w in enumerate(listed)],
                       dtype=np.int64)
    class_mass = np.zeros(1 + CLASS_WORDS + SUFFIXES)
    class_mass[0] = ends
    kinds = np.zeros(1 + CLASS_WORDS + SUFFIXES)
    word_class = {w: 1 + i for i, w in enumerate(listed[:CLASS_WORDS])}
    top = spark.sparkContext.broadcast(word_class)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, kind = np.zeros(len(class_mass)), np.zeros(len(class_mass))
        for batch in batches_of(batches):
            own = np.array([top.value.get(w) or suffix_class(w)
                            for w in batch.column("word").to_pylist()], dtype=np.int64)
            mass += np.bincount(own, batch.column("n").to_numpy(), minlength=len(mass))
            kind += np.bincount(own, minlength=len(kind))
        some = np.flatnonzero(kind)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(mass[some]), pa.array(kind[some])],
                                         names=["c", "mass", "kinds"])

    for r in (counts.mapInArrow(tally, "c long, mass double, kinds double")
              .groupBy("c").agg(F.sum("mass").alias("mass"), F.sum("kinds").alias("kinds")).collect()):
        class_mass[r["c"]], kinds[r["c"]] = r["mass"], r["kinds"]
    endings = np.zeros(len(class_mass), dtype=np.int64)
    endings[1:1 + len(word_class)] = [zlib.crc32(w[-2:]) % SUFFIXES for w in listed[:CLASS_WORDS]]
    endings[1 + CLASS_WORDS:] = np.arange(SUFFIXES)
    shared = spark.sparkContext.broadcast(
        (uuid.uuid4().hex, b"".join(listed), np.array([len(w) for w in listed], dtype=np.int64),
         np.array([c for c, _ in common], dtype=np.int64), classes, class_mass))

    # log10 of a class's mass over the words in it: words of a suffix class and one unknown
    spread = np.log10(class_mass + SMOOTH * (kinds + 1))
    encoded = stage(_encoded(docs, held_out, shared, ends, spread))
    model = Model(class_mass, endings, states)
    if ends:
        train_model(encoded.where(~F.col("held_out")), model, n_all, rounds, tolerance)

    rare = encoded.select("key", F.explode("rare").alias("x")).select("key", "x.word", F.col("x.n").alias("k"))
    joined = rare.join(counts, "word", "left").select(
        "key", (F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("w"),
        F.when(F.col("n") > 0, F.col("k")).otherwise(F.lit(0)).alias("k"), F.lit(0).alias("copies"))
    # repeated rows share a key and bring their words once each
    added = (joined.unionAll(encoded.select("key", F.lit(0.0), F.lit(0).cast("long"), F.lit(1)))
             .groupBy("key").agg((F.sum("w") / F.sum("copies")).alias("w"),
                                 (F.sum("k") / F.sum("copies")).cast("long").alias("k")))
    norm = float(np.log10(n_all + SMOOTH * (distinct + 1)))
    return _forward(encoded, model).join(added, "key").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("k")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("weight") + F.col("w") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("total") + F.col("w")).alias("score"))
