"""Quality classifier by positive-unlabelled learning (operator 3).

Trusted positives are the training texts whose label says 1 (and never 0); the unlabelled
sample is every training text.  With class prior p and logistic loss l the model minimises
the non-negative unbiased risk

    p E_pos[l(z)] + max(0, E_unl[l(-z)] - p E_pos[l(-z)])  +  ridge / 2 |w|^2

over a linear score z of text statistics.  As l(z) - l(-z) = -z, the risk is the greater of two
convex functions, A = p E_pos[l(z)] and B = E_unl[l(-z)] - p E_pos[z], so it has one minimum: that
of B where the estimated negative risk B - A is not negative there, that of A where it is
negative there, else a point where both are equal.  A step minimises the greater of the two
linear models plus curvature (its dual is a parabola in one number), with backtracking on the
risk itself; the fit ends when the mixed gradient and B - A are below ``TOLERANCE``.  A step is
one Spark pass over the staged statistics that returns sums of values, gradients and curvatures
(bounded by the number of statistics).

The class prior is estimated from positives and unlabelled texts: a classifier of one against
the other is fitted on each half of the training texts and scores the other half; the share of
unlabelled texts above a threshold over that of the positives bounds the prior, and the
threshold with the least bound (with a confidence term for both shares) gives it.

Only the text enters the score.  Null and empty texts have all-zero statistics and a score
like any other; repeated rows get the same score; an empty table gives no rows; a very long text
is one row of statistics.  Without positives every score is 0.5.  Labels with a null id or value
are left out, extra columns are not read, and a tie with the threshold counts as accepted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import batches_of, chunks, give_back, reach_workers, stage

THRESHOLD = 0.7
#: Steps of one search at most, halvings of one step, greatest gradient entry at a minimum, and that
#: of the two classifiers that only serve the class prior.
STEPS, HALVINGS, TOLERANCE, ROUGH = 40, 20, 1e-5, 1e-3
#: Bins of the score when the class prior is estimated, and the confidence of its bounds.
PRIOR_BINS, PRIOR_DELTA = 4096, 0.1
#: Ridge of the fit: this much, and more where positives are few (the risk estimate's noise
#: falls with their number): RIDGE + FEW / positives.
RIDGE, FEW = 1e-3, 6.0
#: Scores are clipped to this many standard deviations of a statistic.
CLIP = 6.0
NAMES = ("log_chars", "log_words", "upper", "digit", "space", "high", "stop", "comma", "pipe", "bang",
         "quest", "hash", "percent", "amp", "dollar", "star", "other", "word_len", "word_sd", "distinct",
         "top_word", "same_next", "pair_repeat", "line_repeat", "log_line", "long_word", "short_word",
         "all_caps", "capital", "marked_end")


def statistics(text: bytes) -> list[float]:
    """Shares and lengths that tell prose from menus, symbol junk, shouting and repetition."""
    if not text:
        return [0.0] * len(NAMES)
    n = len(text)
    byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    count = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    of = lambda chars: float(byte[list(chars)].sum()) / n
    named = of(b".,|!?#%&$*")
    ascii_marks = of(range(33, 48)) + of(range(58, 65)) + of(range(91, 97)) + of(range(123, 127))
    caps = sum(w.isupper() for w in words)
    marked = sum(w[-1] in b"|!#%&$*" for w in words)
    return [np.log1p(n), np.log1p(len(words)), of(range(65, 91)), of(range(48, 58)), of(b" \t\r\n"),
            of(range(128, 256)), of(b"."), of(b","), of(b"|"), of(b"!"), of(b"?"), of(b"#"), of(b"%"),
            of(b"&"), of(b"$"), of(b"*"), max(0.0, ascii_marks - named), float(size.mean()),
            float(size.std()), len(count) / m, max(count.values(), default=0) / m, same / m,
            1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
            1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
            float((size > 15).mean()), float((size < 4).mean()), caps / m,
            sum(w[:1].isupper() for w in words) / m, marked / m]


def with_shape(x: np.ndarray) -> np.ndarray:
    """Statistics, and the logarithm of the shares, which spreads their small values."""
    return np.concatenate([x, np.log(np.abs(x) + 1e-3)], axis=1)


def measured(docs: DataFrame, *columns) -> DataFrame:
    """The given columns and ``x``, the statistics of the text."""
    reach_workers(docs.sparkSession)
    kept = docs.select(*columns, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for part in chunks(batch):
                x = np.array([statistics(t) for t in part.column("text").to_pylist()], dtype=np.float32)
                flat = pa.array(x.ravel())
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), flat)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists],
                                                 names=[*names, "x"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, x array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)


def _total(frame: DataFrame, per_batch, width: int) -> np.ndarray:
    """Sum over all rows of ``per_batch(statistics, is positive, is in the second half)``, an
    array of ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches_of(batches):
            if batch.num_rows:
                total += per_batch(matrix(batch.column("x")),
                                   *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("positive", "half")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)],
                                         names=["i", "s"])

    out = np.zeros(width)
    for r in (frame.select("x", "positive", "half").mapInArrow(run, "i int, s double")
              .groupBy("i").agg(F.sum("s").alias("s")).collect()):
        out[r["i"]] = r["s"]
    return out


class Model:
    """Linear score of standardised statistics; ``prior`` stands in where nothing was learned.
    ``risk`` and ``negative_risk`` are those of the weights on the training texts."""

    def __init__(self, prior: float):
        self.prior, self.weights = prior, None
        self.mean = self.sd = None
        self.risk = self.negative_risk = None

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((with_shape(x) - self.mean) / self.sd, -CLIP, CLIP)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -60, 60)))


class Parts:
    """Means at some weights, over the unlabelled: l(-z) with gradient and curvature; over the
    positives: l(z) with gradient and curvature, and z with its gradient."""

    def __init__(self, total: np.ndarray, size: int):
        n_unl, n_pos, unl, pos, z = total[:5]
        vectors = total[5:5 + 3 * size].reshape(3, size)
        curves = total[5 + 3 * size:].reshape(2, size, size)
        self.unl, self.unl_slope, self.unl_curve = unl / n_unl, vectors[0] / n_unl, curves[0] / n_unl
        self.pos, self.pos_slope, self.pos_curve = pos / n_pos, vectors[1] / n_pos, curves[1] / n_pos
        self.z, self.z_slope = z / n_pos, vectors[2] / n_pos

    @staticmethod
    def of(a: np.ndarray, positive: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = np.clip(a @ w, -60, 60)
        p = 1 / (1 + np.exp(-z))
        bend = p * (1 - p)
        own, q = a[positive], p[positive]
        return np.concatenate([
            [len(a), len(own), np.logaddexp(0, z).sum(), np.logaddexp(0, -z[positive]).sum(), z[positive].sum()],
            a.T @ p, own.T @ (q - 1), own.sum(axis=0),
            ((a * bend[:, None]).T @ a).ravel(), ((own * bend[positive][:, None]).T @ own).ravel()])

    def risks(self, prior: float) -> tuple[float, float]:
        """A and B; the estimated negative risk is B - A."""
        return prior * self.pos, self.unl - prior * self.z


def newton(weigh, ridge: np.ndarray, w: np.ndarray, tolerance: float):
    """Search for the least weigh(parts) + ridge (``weigh`` gives value, gradient and curvature of
    a convex function).  A generator: it yields weights, is sent their parts, and returns both."""
    parts = yield w
    for _ in range(STEPS):
        value, slope, curve = weigh(parts)
        value, slope = value + 0.5 * float(ridge @ (w * w)), slope + ridge * w
        if np.abs(slope).max() < tolerance:
            break
        step = -np.linalg.solve(curve + np.diag(ridge + 1e-9), slope)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        gain = float(slope @ step)
        for _ in range(HALVINGS):
            there = yield w + step
            if weigh(there)[0] + 0.5 * float(ridge @ ((w + step) ** 2)) <= value + 1e-4 * gain + 1e-13:
                break
            step, gain = step / 2, gain / 2
        else:
            break                                     # no digits left to gain
        w, parts = w + step, there
    return w, parts


def non_negative(prior: float, ridge: np.ndarray, w: np.ndarray, tolerance: float):
    """Search for the least non-negative risk max(A, B) + ridge, a generator like ``newton``.

    Each step minimises the greater of the two linear models plus the curvature of their last
    mixture v A + (1 - v) B; its dual is a quadratic in v alone.  Returns weights, parts and v."""
    parts, v = (yield w), 0.0

    def risk(p, w):
        return max(p.risks(prior)) + 0.5 * float(ridge @ (w * w))

    for _ in range(STEPS):
        a, b = parts.risks(prior)
        slope_a, slope_b = prior * parts.pos_slope, parts.unl_slope - prior * parts.z_slope
        curve = v * prior * parts.pos_curve + (1 - v) * parts.unl_curve + np.diag(ridge + 1e-9)
        back = np.linalg.solve(curve, np.stack([slope_b + ridge * w, slope_a - slope_b], axis=1))
        # the step for a mixture v is -(back[0] + v back[1]); the two models meet where B - A is zero
        apart = slope_b - slope_a
        bend = float(apart @ back[:, 1])
        v = 0.0 if bend >= -1e-300 else min(max((b - a - float(apart @ back[:, 0])) / bend, 0.0), 1.0)
        step = -(back[:, 0] + v * back[:, 1])
        residual = v * slope_a + (1 - v) * slope_b + ridge * w
        tied = v in (0.0, 1.0) or abs(b - a) < tolerance
        if np.abs(residual).max() < tolerance and tied:
            break
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        now, bent = risk(parts, w), float(step @ curve @ step)
        for _ in range(HALVINGS):
            there = yield w + step
            if risk(there, w + step) <= now - 1e-4 * bent + 1e-13:
                break
            step, bent = step / 2, bent / 4
        else:
            break                                     # no digits left to gain
        w, parts = w + step, there
    return w, parts, v


def drive(searches: list, parts_at) -> list:
    """Results of searches that go side by side: one pass evaluates a step of each of them.
    ``parts_at`` takes {number: weights} and returns {number: parts}."""
    pending = {i: next(g) for i, g in enumerate(searches)}
    found: dict = {}
    while pending:
        parts = parts_at(pending)
        for i in list(pending):
            try:
                pending[i] = searches[i].send(parts[i])
            except StopIteration as end:
                found[i] = end.value
                del pending[i]
    return [found[i] for i in range(len(searches))]


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Class prior from counts of both samples per score bin (ascending)."""
    n_pos, n_unl = positive.sum(), unlabelled.sum()
    above_pos = np.cumsum(positive[::-1]) / n_pos
    above_unl = np.cumsum(unlabelled[::-1]) / n_unl
    some = above_pos > 0
    above_pos, above_unl = above_pos[some], above_unl[some]
    doubt = np.sqrt(np.log(4 / PRIOR_DELTA) / (2 * n_unl)) + np.sqrt(np.log(4 / PRIOR_DELTA) / (2 * n_pos))
    at = int(np.argmin((above_unl + doubt) / above_pos))
    return float(min(max(above_unl[at] / above_pos[at], 0.01), 0.99))


def labelled(labels: DataFrame, trained: Column) -> DataFrame:
    """(doc_id, positive) of the trusted training labels; an id with both labels is no positive."""
    return (labels.where(trained & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
            .groupBy("doc_id").agg((F.min("quality") == 1).alias("positive")))


def fit(measures: DataFrame, labels: DataFrame, trained: Column) -> Model:
    """Model from staged ``measures`` (doc_id, x) and labels (doc_id, quality); only rows with
    ``trained`` true are read."""
    known = labelled(labels, trained)
    model = Model(0.5)
    # the half is a matter of the text alone: copies never stand on both sides
    rows = stage(measures.where(trained).select("doc_id", "x").join(known, "doc_id", "left")
                 .select("x", F.coalesce("positive", F.lit(False)).alias("positive"),
                         (F.pmod(F.xxhash64("x"), F.lit(2)) == 1).alias("half")))
    k = 2 * len(NAMES)

    def moments(x, positive, half):
        z = with_shape(x)
        return np.r_[z.sum(axis=0), (z * z).sum(axis=0), len(z), positive.sum(), half.sum(), (positive & half).sum()]

    total = _total(rows, moments, 2 * k + 4)
    n_unl, n_pos, n_half, n_pos_half = total[-4:]
    if not n_pos:
        return model
    model.mean = total[:k] / n_unl
    spread = np.sqrt(np.maximum(total[k:2 * k] / n_unl - model.mean ** 2, 0))
    model.sd = np.where(spread > 1e-9, spread, 1.0)
    size = k + 1
    width = 5 + 3 * size + 2 * size * size

    def parts_of(wanted: dict, sides: list):
        """Parts at several weights in one pass, each over one half of the rows or (None) all."""
        order = sorted(wanted)

        def per_batch(x, positive, half):
            out = []
            for i in order:
                own = slice(None) if sides[i] is None else half == sides[i]
                out.append(Parts.of(model.design(x[own]), positive[own], wanted[i]))
            return np.concatenate(out)

        total = _total(rows, per_batch, width * len(order)).reshape(len(order), width)
        return {i: Parts(t, size) for i, t in zip(order, total)}

    def ridge_for(positives):
        ridge = np.full(size, RIDGE + FEW / positives)
        ridge[-1] = 0.0
        return ridge

    start = np.zeros(size)
    if 0 < n_pos_half < n_pos:
        def either(p: Parts):                         # positives against unlabelled, both weigh the same
            return (p.pos + p.unl) / 2, (p.pos_slope + p.unl_slope) / 2, (p.pos_curve + p.unl_curve) / 2

        first, second = drive([newton(either, ridge_for(n), start, ROUGH)
                               for n in (n_pos - n_pos_half, n_pos_half)],
                              lambda wanted: parts_of(wanted, [False, True]))

        def bins(x, positive, half):
            a = model.design(x)
            z = np.where(half, a @ first[0], a @ second[0])
            b = np.clip(PRIOR_BINS / (1 + np.exp(-np.clip(z, -60, 60))), 0, PRIOR_BINS - 1).astype(np.int64)
            return np.r_[np.bincount(b[positive], minlength=PRIOR_BINS), np.bincount(b, minlength=PRIOR_BINS)]

        counts = _total(rows, bins, 2 * PRIOR_BINS)
        model.prior = prior_of(counts[:PRIOR_BINS], counts[PRIOR_BINS:])
    else:
        model.prior = min(max(n_pos / n_unl, 0.01), 0.99)
    start[-1] = np.log(model.prior / (1 - model.prior))
    model.weights, parts, _ = drive([non_negative(model.prior, ridge_for(n_pos), start, TOLERANCE)],
                                    lambda wanted: parts_of(wanted, [None]))[0]
    a, b = parts.risks(model.prior)
    model.risk, model.negative_risk = max(a, b), b - a
    return model


def score_measures(measures: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``measures`` without x, with score and predicted."""
    names = [c for c in measures.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            s = model.scores(matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[*names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measures.schema if f.name != "x")
    return measures.mapInArrow(run, f"{schema}, score double, predicted int")


def scorer(model: Model):
    """Column function text -> score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t.encode("utf-8", "surrogatepass")) for t in texts.fillna("")],
                     dtype=np.float32).reshape(-1, len(NAMES))
        out = pd.Series(model.scores(x.astype(np.float64)))
        give_back()
        return out

    return score


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every text; labels whose ``held_out`` (an
    expression of doc_id) is true are not read."""
    measures = stage(measured(docs, "doc_id", held_out.alias("held_out")))
    model = fit(measures, labels, ~held_out)
    return score_measures(measures, model, threshold)
