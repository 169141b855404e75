"""Language identification with interpolated Kneser-Ney character models (operator 4).

A text is its words (runs of letters, lower case), each padded with blanks, so a character
is predicted from the ``ORDER`` - 1 before it inside its word.  Tasks count the top-order
character n-grams per language from distinct words; one shuffle sums them.  The lower orders
of Kneser-Ney are numbers of distinct left neighbours and follow from those n-grams alone.
Per language and order the model is two sorted arrays of 64-bit hashes (an n-gram is packed
into 64 bits and scrambled one-to-one) with the discounted share beside each n-gram and the
back-off weight beside each context; a lookup is a binary search.

A text takes the language with the lowest cross-entropy per character (ties: first name).
Rejection is calibrated on all training texts under their own language's model.  A text is
not of a language if its cross-entropy lies above the language's median by ``SPREADS`` times
the distance of the upper quartile and by ``TO_UNIFORM`` of the way from the median to a
uniform guess over the alphabet.  Less than a quarter of outliers cannot stretch this, copies
of one text cannot close it, and every learned language has a limit.  Texts under ``SHORT``
characters are not rejected for it.

Every language value of the training texts is learned from all its n-grams.  Languages of at
most ``MAX_NGRAMS`` n-grams (``MAX_BROADCAST`` over all languages) are looked up in a broadcast.
The model of a larger one stays a table: discounts, context masses and lower orders come from
Spark aggregates, and the distinct n-grams of the texts are joined with it.  Both give the
same probabilities.

``und`` (score 0, rejected): null text, no letter, or no language to learn.
Repeated rows get the same answer; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import CHUNK_BYTES, batches_of, give_back, named, reach_workers, stage

ORDER = 4
MAX_NGRAMS = 1 << 18
MAX_BROADCAST = 1 << 22
SPREADS = 18.0
TO_UNIFORM = 2 / 3
SHORT = 25
SHARPNESS = 20.0
U = np.uint64
LETTERS = regex.compile(r"\p{L}+")


def scramble(x: np.ndarray) -> np.ndarray:
    """One-to-one hash of 64-bit words."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed top-order n-grams of the words, flat, and their number per word (length + 1).
    Characters take 16 bits; those beyond the basic plane are folded into it."""
    pad = " " * (ORDER - 1)
    code = np.frombuffer((pad + pad.join(words) + pad).encode("utf-32-le"), dtype=np.uint32)
    code = ((code ^ (code >> 16) * np.uint32(40503)) & np.uint32(0xFFFF)).astype(U)
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    # the word that starts at s (after its padding) has n-grams starting at s - 3 .. s + length - 3
    start = np.cumsum(n + ORDER - 2) - (n + ORDER - 2)
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    key = np.zeros(len(at), dtype=U)
    for i in range(ORDER):
        key = (key << U(16)) | code[at + i]
    return key, n


def find(table: np.ndarray, values: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Value beside each hash in the sorted array, 0 where it is absent."""
    if not len(table):
        return np.zeros(len(key))
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, values[at], 0.0)


class KneserNey:
    """One language's model from its top-order n-grams and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.floor = 1.0 / alphabet
        self.orders = []
        counts = counts.astype(np.float64)
        for n in range(ORDER, 0, -1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
            context = keys >> U(16)
            names, inverse = np.unique(context, return_inverse=True)
            mass = np.bincount(inverse, counts)
            kinds = np.bincount(inverse)
            gram_hash, context_hash = scramble(keys), scramble(names)
            a, b = np.argsort(gram_hash), np.argsort(context_hash)
            self.orders.append((n, gram_hash[a], ((counts - discount) / mass[inverse])[a],
                                context_hash[b], (discount * kinds / mass)[b]))
            # next order: distinct left neighbours of each shorter n-gram
            keys, left = np.unique(keys & U((1 << 16 * (n - 1)) - 1), return_counts=True)
            counts = left.astype(np.float64)

    def log_prob(self, key: np.ndarray) -> np.ndarray:
        """Natural log of P(last character | the ones before) of packed n-grams."""
        p = np.full(len(key), self.floor)
        for n, grams, share, contexts, weight in reversed(self.orders):
            own = key & U((1 << 16 * n) - 1)
            hashed = scramble(own >> U(16))
            at = np.minimum(np.searchsorted(contexts, hashed), len(contexts) - 1)
            known = contexts[at] == hashed
            p = np.where(known, find(grams, share, scramble(own)) + weight[at] * p, p)
        return np.log(p)


class Identifier:
    """Languages with their models; a language without one is ``joined`` from its table."""

    def __init__(self, langs: list[str], models: list[KneserNey | None], alphabet: int):
        self.langs, self.models, self.uniform = langs, models, math.log(alphabet)
        self.joined = [x for x, m in zip(langs, models) if m is None]

    def entropies(self, texts: list[str], joined: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (texts x languages) and number of characters; ``joined``
        holds each text's log probabilities of the joined languages."""
        words = [LETTERS.findall(t.lower()) for t in texts]
        n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = [w for ws in words for w in ws]
        out, chars = np.full((len(texts), len(self.langs)), np.inf), np.zeros(len(texts), dtype=np.int64)
        if not flat or not self.langs:
            return out, chars
        distinct = list(set(flat))
        place = dict(zip(distinct, range(len(distinct))))
        ids = np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat))
        key, n = ngrams(distinct)
        some, inverse = np.unique(key, return_inverse=True)
        first = np.cumsum(n) - n
        per_word = np.stack([np.zeros(len(n)) if m is None else np.add.reduceat(m.log_prob(some)[inverse], first)
                             for m in self.models], axis=1)
        full = np.flatnonzero(n_words)
        begin = (np.cumsum(n_words) - n_words)[full]
        chars[full] = np.add.reduceat(n[ids], begin)
        total = np.add.reduceat(per_word[ids], begin, axis=0)
        if self.joined:
            total[:, [m is None for m in self.models]] = np.stack([joined[i] for i in full])
        out[full] = -total / chars[full][:, None]
        return out, chars

    def answer(self, texts: list[str], langs: list[str | None], joined: list) -> pd.DataFrame:
        """Prediction of each text, and its cross-entropy under its own language ``langs``."""
        h, chars = self.entropies(texts, joined)
        some = chars > 0
        if not self.langs:
            return pd.DataFrame({"lang_pred": "und", "score": 0.0, "cross_entropy": None,
                                 "own_entropy": None, "chars": 0}, index=range(len(texts)))
        best = h.argmin(axis=1)
        rows = np.arange(len(h))
        low = h[rows, best]
        place = dict(zip(self.langs, range(len(self.langs))))
        own = np.fromiter((place.get(x, -1) for x in langs), dtype=np.int64, count=len(h))
        with np.errstate(invalid="ignore"):
            score = 1 / np.exp(-SHARPNESS * (h - low[:, None])).sum(axis=1)
        return pd.DataFrame({
            "lang_pred": np.where(some, np.array(self.langs, dtype=object)[best], "und"),
            "score": np.where(some, score, 0.0),
            "cross_entropy": pd.Series(np.where(some, low, np.nan)).where(pd.Series(some), None),
            "own_entropy": pd.Series(h[rows, own]).where(pd.Series(some & (own >= 0)), None),
            "chars": np.where(some, chars, 0)})


def slices(texts: list[str], max_bytes: int = CHUNK_BYTES) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > max_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counts(train: DataFrame, flush: int = 100_000) -> DataFrame:
    """(lang, gram, n): top-order n-grams of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out():
            for lang, words in held.items():
                if not words:
                    continue
                key, n = ngrams(list(words))
                some, inverse = np.unique(key, return_inverse=True)
                total = np.bincount(inverse, np.repeat(list(words.values()), n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array(some.view(np.int64)),
                     pa.array(total.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches_of(batches):
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                held.setdefault(lang.as_py(), Counter()).update(LETTERS.findall(text.as_py().lower()))
                if sum(map(len, held.values())) > flush:
                    yield from out()
        yield from out()

    return (train.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def fit(train: DataFrame) -> tuple[Identifier, DataFrame]:
    """Models from ``train`` (lang, text): its whole texts with a language; and the staged n-gram
    counts they come from."""
    reach_workers(train.sparkSession)
    train = train.where(F.col("lang").isNotNull()).select(
        "lang", F.coalesce("text", F.lit("")).alias("text"))
    counts = stage(_counts(train))
    size = {r["lang"]: r["k"] for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).collect()}
    langs, held, room = sorted(size), [], MAX_BROADCAST
    if not langs:
        return Identifier([], [], 1), counts
    for lang in sorted(langs, key=lambda x: (size[x], x)):
        if size[lang] <= min(MAX_NGRAMS, room):
            held.append(lang)
            room -= size[lang]
    # at most 2^16 characters
    alphabet = counts.select(F.col("gram").bitwiseAND(0xFFFF)).distinct().count() + 1
    kept = counts.where(F.col("lang").isin(held)).toArrow()       # at most MAX_BROADCAST rows
    by_lang = kept.column("lang").to_pandas()
    grams = kept.column("gram").to_numpy().view(U)
    n = kept.column("n").to_numpy()
    models = [KneserNey(grams[own], n[own], alphabet) if len(own) else None
              for own in (np.flatnonzero(by_lang == lang) for lang in langs)]
    return Identifier(langs, models, alphabet), counts


def _grams_of(rows: DataFrame) -> DataFrame:
    """(row, gram, times): distinct top-order n-grams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                words = Counter(LETTERS.findall((text.as_py() or "").lower()))
                if words:
                    key, n = ngrams(list(words))
                    some, inverse = np.unique(key, return_inverse=True)
                    times = np.bincount(inverse, np.repeat(list(words.values()), n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), row)), pa.array(some.view(np.int64)),
                         pa.array(times.astype(np.int64))], names=["row", "gram", "times"])

    return rows.select("row", "text").mapInArrow(run, "row long, gram long, times long")


def _joined(rows: DataFrame, identifier: Identifier, counts: DataFrame) -> DataFrame:
    """(row, joined): log probability of each text under each joined language, the same
    recursion as ``KneserNey`` over tables."""
    spark, langs = rows.sparkSession, identifier.joined
    own = stage(_grams_of(rows))
    names = F.broadcast(spark.createDataFrame([(x,) for x in langs], "lang string"))
    found = (own.select("gram").distinct().crossJoin(names)
             .withColumn("p", F.lit(math.exp(-identifier.uniform))))
    tables = {ORDER: counts.where(F.col("lang").isin(langs))}
    for n in range(ORDER - 1, 0, -1):
        short = F.col("gram").bitwiseAND((1 << 16 * n) - 1).alias("gram")
        tables[n] = stage(tables[n + 1].select("lang", short).groupBy("lang", "gram")
                          .agg(F.count(F.lit(1)).alias("n")))
    for n in range(1, ORDER + 1):
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = F.when(ones > 0, F.least(F.lit(0.9), F.greatest(
            F.lit(0.1), ones / (ones + 2 * twos)))).otherwise(0.1)
        # one row per language
        cut = F.broadcast(tables[n].groupBy("lang").agg(discount.alias("d")))
        context = F.shiftrightunsigned("gram", 16).alias("context")
        contexts = tables[n].groupBy("lang", context).agg(
            F.sum("n").alias("mass"), F.count(F.lit(1)).alias("kinds")).join(cut, "lang")
        if n == 1:
            contexts = F.broadcast(contexts)          # the empty context of each language
        whole = F.col("gram").bitwiseAND((1 << 16 * n) - 1) if n < ORDER else F.col("gram")
        found = (found.withColumn("part", whole)
                 .withColumn("context", F.shiftrightunsigned("part", 16))
                 .join(contexts, ["lang", "context"], "left")
                 .join(tables[n].withColumnRenamed("gram", "part"), ["lang", "part"], "left")
                 .withColumn("p", F.when(F.col("mass").isNull(), F.col("p")).otherwise(
                     F.coalesce((F.col("n") - F.col("d")) / F.col("mass"), F.lit(0.0))
                     + F.col("d") * F.col("kinds") / F.col("mass") * F.col("p")))
                 .select("gram", "lang", "p"))
    logs = (found.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("lang", F.log("p").alias("x"))))
                                      .alias("logs")))
    # decimal sums do not depend on their order: repeated rows get equal sums
    sums = [F.sum((F.col("times") * F.col("logs")[i]["x"]).cast("decimal(28,15)")).cast("double")
            for i in range(len(langs))]
    return own.join(logs, "gram").groupBy("row").agg(F.array(*sums).alias("joined"))


_HELD: dict = {}


def predictor(frame: DataFrame, identifier: Identifier):
    """Column function (text, own language or null, log probabilities of the joined languages or
    null) -> struct(lang_pred, score, cross_entropy, own_entropy, chars)."""
    tag = uuid.uuid4().hex
    shared = frame.sparkSession.sparkContext.broadcast(identifier)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, own_entropy double, chars long")
    def predict(texts: pd.Series, langs: pd.Series, joined: pd.Series) -> pd.DataFrame:
        if tag not in _HELD:
            _HELD.clear()
            _HELD[tag] = shared.value
        own, more, parts, at = langs.tolist(), joined.tolist(), [], 0
        for some in slices(texts.fillna("").tolist()):
            parts.append(_HELD[tag].answer(some, own[at:at + len(some)], more[at:at + len(some)]))
            at += len(some)
        give_back()
        return pd.concat(parts, ignore_index=True) if parts else _HELD[tag].answer([], [], [])

    return predict


def limits(told: DataFrame, uniform: float) -> DataFrame:
    """lang, limit: rejection limit per language, from all training texts of ``told``;
    ``uniform`` is the cross-entropy of a uniform guess."""
    q = F.percentile_approx("p.own_entropy", F.array(F.lit(0.5), F.lit(0.75)), 10_000)
    median, upper = F.col("q")[0], F.col("q")[1]
    return (told.where("p.own_entropy IS NOT NULL").groupBy("lang").agg(q.alias("q"))
            .select("lang", (median + F.greatest(SPREADS * (upper - median),
                                                 TO_UNIFORM * (F.lit(uniform) - median))).alias("limit")))


def judge(docs: DataFrame, held_out: Column, carry: list[str]) -> DataFrame:
    """doc (struct of the columns ``carry``), held_out, lang (of training texts), p (the
    prediction) and rejected of every text; learns from texts whose ``held_out`` is false.  Every text is scored once; the limits
    come from the written scores."""
    identifier, counts = fit(docs.where(~held_out))
    rows = docs.select(F.struct(*map(named, carry)).alias("doc"), held_out.alias("held_out"),
                       F.when(~held_out, F.col("lang")).alias("lang"), "text",
                       F.lit(None).cast("array<double>").alias("joined"))
    if identifier.joined:
        rows = stage(rows.drop("joined").withColumn("row", F.monotonically_increasing_id()))
        rows = rows.join(_joined(rows, identifier, counts), "row", "left")
    predict = predictor(docs, identifier)
    told = stage(rows.select("doc", "held_out", "lang", predict("text", "lang", "joined").alias("p")))
    # one row per language
    known = F.broadcast(limits(told, identifier.uniform).select(F.col("lang").alias("known"), "limit"))
    refused = (F.col("p.chars") == 0) | ((F.col("p.cross_entropy") > F.col("limit"))
                                         & (F.col("p.chars") >= SHORT))
    return (told.join(known, F.col("p.lang_pred") == F.col("known"), "left")
            .select("doc", "held_out", "lang", "p", refused.alias("rejected")))


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of every text; learns from
    texts whose ``held_out`` is false."""
    return judge(docs, held_out, ["doc_id"]).select(
        "doc.doc_id", "held_out", "p.lang_pred", "p.score", "p.cross_entropy", "rejected")
