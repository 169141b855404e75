"""Language model, language identification and quality classifier."""
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casebook.llm import hmm, langid_kn, quality_pu
from casebook.llm.common import fold, stage

from .helpers import awkward_texts, documents


def held(i, n, r=0):
    return zlib.crc32(str(i).encode()) % n == r


def babble(seed, n=120):
    """Texts of two 'languages' with words of their own."""
    rnd = random.Random(seed)
    words = {"en": ["the", "thing", "ofter", "ration", "wholly", "A", "reading"],
             "de": ["der", "über", "schlich", "keitung", "Ein", "verpf", "großheit"]}
    langs = [rnd.choice(["en", "de"]) for _ in range(n)]
    return [" ".join(rnd.choice(words[x]) for _ in range(rnd.randint(1, 80))) for x in langs], langs


def test_base_score_and_counts_equal_brute_force(spark):
    texts = awkward_texts() + babble(1)[0]
    rows = {r.doc_id: r for r in hmm.score(documents(spark, texts), fold("doc_id", 10) == 0,
                                           states=2, rounds=1).collect()}
    tokens = {i: [w.lower() for w in (t or "").encode().split()] + [None] for i, t in enumerate(texts)}
    count = Counter(w for i, ws in tokens.items() if not held(i, 10) for w in ws)
    total, kinds = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for i, ws in tokens.items():
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            held(i, 10), len(ws), sum(w in count for w in ws), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_words_outside_the_broadcast_are_joined(spark, monkeypatch):
    texts = awkward_texts() + babble(1)[0]
    want = {r.doc_id: r for r in hmm.score(documents(spark, texts), fold("doc_id", 10) == 0, 2, 0).collect()}
    monkeypatch.setattr(hmm, "WORD_BYTES", 3)
    got = {r.doc_id: r for r in hmm.score(documents(spark, texts), fold("doc_id", 10) == 0, 2, 0).collect()}
    for i, r in want.items():
        assert math.isclose(r.base_score, got[i].base_score, rel_tol=1e-9) and r.n_known == got[i].n_known


def test_counts_above_the_cap_keep_the_driver_bound(spark, monkeypatch):
    """Many words beyond COUNT_CAP: the levels above it still leave at most VOCAB_WORDS words."""
    monkeypatch.setattr(hmm, "COUNT_CAP", 2)
    monkeypatch.setattr(hmm, "VOCAB_WORDS", 6)
    texts = [" ".join(f"w{i}" for i in range(40) for _ in range(1 + (i < 20) * 3 + (i < 4) * 40))] * 2
    rows = hmm.score(documents(spark, texts), F.lit(False)).collect()
    monkeypatch.undo()
    plain = hmm.score(documents(spark, texts), F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens) for r in rows] == [(r.n_known, r.train_tokens) for r in plain]
    assert all(math.isclose(a.base_score, b.base_score, rel_tol=1e-9) and math.isfinite(a.score)
               for a, b in zip(rows, plain))


def plain_hmm(texts, held_out, states, rounds):
    """log10 likelihood of every text under a model trained with loops over tokens and states."""
    words = [(t or "").encode().lower().split() for t in texts]
    train = [w for w, h in zip(words, held_out) if not h]
    count = Counter(x for w in train for x in w)
    listed = sorted(count, key=lambda w: (-count[w], w))
    number = {w: 1 + i for i, w in enumerate(listed)}
    size = 1 + hmm.CLASS_WORDS + hmm.SUFFIXES
    mass, endings = np.zeros(size), np.zeros(size, dtype=np.int64)
    mass[0] = len(train)
    for w, i in number.items():
        mass[i] = count[w]
        endings[i] = zlib.crc32(w[-2:]) % hmm.SUFFIXES
    endings[1 + hmm.CLASS_WORDS:] = np.arange(hmm.SUFFIXES)
    model = hmm.Model(mass, endings, states)

    def lattice(symbols):
        start, move, emit = model.tables()
        alpha = [start * emit[symbols[0]]]
        for s in symbols[1:]:
            alpha.append((alpha[-1] @ move) * emit[s])
        beta = [np.ones(states)]
        for s in symbols[:0:-1]:
            beta.append(move @ (emit[s] * beta[-1]))
        return alpha, beta[::-1]

    seen = []
    for _ in range(rounds):
        started, moved, emitted, log = np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0
        _, move, emit = model.tables()
        for w in train:
            symbols = [number[x] for x in w] + [0]
            alpha, beta = lattice(symbols)
            total = alpha[-1].sum()
            log += np.log(total)
            for t, s in enumerate(symbols):
                emitted[s] += alpha[t] * beta[t] / total
                if t:
                    moved += alpha[t - 1][:, None] * move * (emit[s] * beta[t])[None, :] / total
            started += alpha[0] * beta[0] / total
        seen.append(log / (sum(map(len, train)) + len(train)))
        model.update(started, moved, emitted)
    out = []
    for w in words:
        share, symbols = 0.0, []
        for x in w:
            if x in number:
                symbols.append(number[x])
            else:
                symbols.append(hmm.suffix_class(x))
                share += np.log10(hmm.SMOOTH) - np.log10(hmm.SMOOTH)        # an empty class: its one unknown word
        out.append(np.log10(lattice(symbols + [0])[0][-1].sum()) + share)
    return out, seen


def test_score_equals_plain_baum_welch_and_forward(spark):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice("The cat sat on a mat and ran".split()) for _ in range(rnd.randint(0, 9)))
             for _ in range(40)] + [None, "unseen Words here", "the the the"]
    docs = documents(spark, texts)
    held_out = [held(i, 10) for i in range(len(texts))]
    for states, rounds in ((1, 1), (2, 3), (3, 4)):
        want, _ = plain_hmm(texts, held_out, states, rounds)
        got = {r.doc_id: r.score for r in hmm.score(docs, fold("doc_id", 10) == 0, states, rounds, 0.0).collect()}
        for i, w in enumerate(want):
            assert math.isclose(got[i], w, rel_tol=2e-4, abs_tol=2e-4), (states, texts[i])


def test_training_stops_at_the_tolerance(spark, monkeypatch):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("red green blue one two three".split()) for _ in range(12)) for _ in range(30)]
    seen, inner = [], hmm.train_model
    monkeypatch.setattr(hmm, "train_model", lambda *a: seen.append(inner(*a)) or seen[-1])
    hmm.score(documents(spark, texts), F.lit(False), 3).collect()
    gains = np.diff(seen[0])
    assert (gains > -1e-3).all() and gains[-1] < hmm.TOLERANCE and (gains[:-1] >= hmm.TOLERANCE).all()
    want = plain_hmm(texts, [False] * 30, 3, len(seen[0]))[1]
    np.testing.assert_allclose(seen[0], want, rtol=1e-3)


def test_training_beats_the_base_on_held_out_texts(spark):
    texts, _ = babble(3, 300)
    rows = hmm.score(documents(spark, texts), fold("doc_id", 10) == 0, states=4, rounds=4).collect()
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_forward_equals_enumeration_and_backward_agrees():
    rng = np.random.default_rng(0)
    start, move = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    emit = rng.dirichlet(np.ones(5), 3).T
    n = np.array([4, 1, 3])
    classes = rng.integers(0, 5, n.sum())
    grid = hmm.Lattice(n)
    symbol = np.empty(len(classes), dtype=np.int64)
    symbol[grid.slot] = classes
    alpha, scale = grid.forward(start, move, emit[symbol])
    got = grid.sums(np.log(scale))
    at = 0
    for size, total in zip(n, got):
        seq = classes[at:at + size]
        at += size
        p = 0.0
        for code in range(3 ** size):
            path = [code // 3 ** k % 3 for k in range(size)]
            q = start[path[0]] * emit[seq[0], path[0]]
            for a, b, c in zip(path, path[1:], seq[1:]):
                q *= move[a, b] * emit[c, b]
            p += q
        assert math.isclose(math.log(p), total, rel_tol=1e-9)
    started, moved, emitted, log = hmm.expected_counts(n, classes, (start, move, emit))
    assert math.isclose(log, got.sum(), rel_tol=1e-5)
    assert math.isclose(started.sum(), 3, rel_tol=1e-5) and math.isclose(moved.sum(), n.sum() - 3, rel_tol=1e-5)
    assert math.isclose(emitted.sum(), n.sum(), rel_tol=1e-5)
    assert np.allclose(emitted.sum(axis=1), np.bincount(classes, minlength=5), rtol=1e-5)


def test_model_without_training_texts_and_empty_table(spark):
    docs = documents(spark, ["a b", None, "a b"], ids=[0, 1, 0])
    rows = hmm.score(docs, F.lit(True), 2, 1).collect()
    assert [r.n_known for r in rows] == [0, 0, 0] and {r.train_tokens for r in rows} == {0}
    assert hmm.score(docs.limit(0), F.lit(True), 2, 1).count() == 0


def test_repeated_rows_score_alike(spark):
    texts = ["alpha beta", "alpha beta", "gamma"] + ["alpha x"] * 3
    rows = hmm.score(documents(spark, texts, ids=[1, 1, 2, 3, 4, None]), F.col("doc_id") == 1, 2, 1).collect()
    own = [(r.base_score, r.score, r.n_known) for r in rows if r.doc_id == 1]
    assert len(own) == 2 and own[0] == own[1] and len(rows) == 6


def plain_kneser_ney(words):
    """Probability function of an interpolated model, straight from the definition."""
    pad, n = " " * 3, 4
    grams = {k: Counter() for k in range(1, 5)}
    for w, c in words.items():
        s = pad + w + " "
        for i in range(len(w) + 1):
            grams[4][s[i:i + 4]] += c
    for k in (3, 2, 1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    alphabet = len({g[-1] for g in grams[4]}) + 1

    def p(context, c, k):
        if k == 0:
            return 1 / alphabet
        own = grams[k]
        ones, twos = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1
        context = context[-(k - 1):] if k > 1 else ""
        mass = sum(v for g, v in own.items() if g[:-1] == context)
        lower = p(context, c, k - 1)
        if not mass:
            return lower
        kinds = sum(g[:-1] == context for g in own)
        return max(own[context + c] - d, 0) / mass + d * kinds / mass * lower

    return lambda context, c: p(context, c, n)


def test_kneser_ney_equals_the_definition():
    words = Counter({"the": 5, "then": 2, "hat": 1, "über": 3, "x": 1})
    key, n = langid_kn.ngrams(list(words))
    some, inverse = np.unique(key, return_inverse=True)
    counts = np.bincount(inverse, np.repeat(list(words.values()), n)).astype(np.int64)
    alphabet = len(np.unique(some & np.uint64(0xFFFF))) + 1
    model = langid_kn.KneserNey(some, counts, alphabet)
    plain = plain_kneser_ney(words)
    for w in ["the", "hat", "thx", "zq", "über"]:
        s = "   " + w + " "
        key, _ = langid_kn.ngrams([w])
        want = [math.log(plain(s[i:i + 3], s[i + 3])) for i in range(len(w) + 1)]
        assert np.allclose(model.log_prob(key), want)
    # a context's shares add up to one over the alphabet and one unseen character
    chars = sorted({g for w in words for g in w} | {" "})
    assert math.isclose(sum(plain("  t", c) for c in chars) + plain("  t", "☃"), 1.0)


def test_language_of_held_out_texts_and_und(spark):
    texts, langs = babble(5, 200)
    extra = [None, "", "123 !!", "Ⅷ ½", "ž" * 300, "the " * 20000]
    docs = documents(spark, texts + extra, langs=langs + ["en", None, "en", "de", None, "en"])
    rows = {r.doc_id: r for r in langid_kn.identify(docs, fold("doc_id", 5) == 0).collect()}
    assert len(rows) == 206
    unseen = [i for i in range(200) if held(i, 5)]
    assert np.mean([rows[i].lang_pred == langs[i] for i in unseen]) > 0.97
    assert not any(rows[i].rejected for i in range(200))
    for i in (200, 201, 202, 203):
        assert (rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True)
    assert rows[204].lang_pred in ("en", "de") and rows[204].rejected
    assert rows[205].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows.values())
    assert langid_kn.identify(docs.limit(0), fold("doc_id", 5) == 0).count() == 0
    nothing = langid_kn.identify(docs, F.lit(True)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


@pytest.mark.parametrize("bound,broadcast", [(3, 1 << 25), (45, 1 << 25), (1 << 18, 45)])
def test_ngrams_beyond_the_broadcast_are_joined(spark, monkeypatch, bound, broadcast):
    texts, langs = babble(5, 60)
    extra = [None, "", "ž" * 40, "the der über 漢字", "der"]
    docs = documents(spark, texts + extra + texts[:2], langs=langs + [None, "en", None, "de", "fr"] + langs[:2])
    want = {r.doc_id: r for r in langid_kn.identify(docs, fold("doc_id", 5) == 0).collect()}
    monkeypatch.setattr(langid_kn, "MAX_NGRAMS", bound)
    monkeypatch.setattr(langid_kn, "MAX_BROADCAST", broadcast)
    assert langid_kn.fit(docs)[0].joined
    got = {r.doc_id: r for r in langid_kn.identify(docs, fold("doc_id", 5) == 0).collect()}
    assert len(got) == len(want) == 67
    for i, r in want.items():
        assert (r.lang_pred, r.rejected, r.held_out) == (got[i].lang_pred, got[i].rejected, got[i].held_out)
        assert math.isclose(r.score, got[i].score, rel_tol=1e-9)
        assert (r.cross_entropy is None) == (got[i].cross_entropy is None)
        assert r.cross_entropy is None or math.isclose(r.cross_entropy, got[i].cross_entropy, rel_tol=1e-9)


def test_rejection_limits_withstand_outliers_copies_and_rare_languages(spark):
    texts, langs = babble(7, 120)
    rnd = random.Random(2)
    junk = " ".join("".join(rnd.choice("qxzjkvwy") for _ in range(9)) for _ in range(40))
    seen = next(t for t, x in zip(texts, langs) if x == "de" and len(t) > 100)
    docs = documents(spark, texts + [junk] + [seen] * 90 + [texts[0], "ž" * 300],
                     langs=langs + ["en"] + ["de"] * 90 + ["rare", None])
    last = len(texts) + 92
    told = langid_kn.judge(docs, F.col("doc_id") == last, ["doc_id"])
    limit = {r.lang: r.limit for r in langid_kn.limits(told, 3.0).collect()}
    assert set(limit) == {"en", "de", "rare"} and all(map(math.isfinite, limit.values()))
    rows = {r.doc.doc_id: r for r in told.collect()}
    assert rows[last].rejected and not any(rows[i].rejected for i in range(len(texts)))


def quality_tables(spark, n=400):
    rnd = random.Random(9)
    texts, good = [], []
    for i in range(n):
        words = babble(i + 50, 1)[0][0].split() * 2
        ok = rnd.random() < 0.8
        texts.append(" ".join(words) if ok else rnd.choice(
            [" | ".join(words), " ".join(w.upper() + "!!" for w in words), "$$$ ".join(words)]))
        good.append(int(ok))
    labels = spark.createDataFrame(
        [(i, q, 0) for i, q in enumerate(good) if i % 2] + [(None, 1, 0), (3, None, 0)],
        "doc_id long, quality int, toxic int")
    return texts, good, labels


def test_quality_on_held_out_labels(spark):
    texts, good, labels = quality_tables(spark)
    docs = documents(spark, texts + [None, "", "x" * 9000])
    rows = {r.doc_id: r for r in quality_pu.classify(docs, labels, fold("doc_id", 4) == 2).collect()}
    unseen = [i for i in range(len(texts)) if held(i, 4, 2)]
    assert np.mean([rows[i].predicted == good[i] for i in unseen]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert rows[400].score == rows[401].score and len(rows) == 403


def test_quality_without_labels_or_rows(spark):
    texts, _, labels = quality_tables(spark, 20)
    docs = documents(spark, texts)
    assert {r.score for r in quality_pu.classify(docs, labels.limit(0), F.lit(False)).collect()} == {0.5}
    assert quality_pu.classify(docs.limit(0), labels, F.lit(False)).count() == 0


def test_held_out_labels_are_not_read(spark):
    texts, good, labels = quality_tables(spark, 120)
    flipped = labels.withColumn("quality", F.when(fold("doc_id", 4) == 2, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    docs = documents(spark, texts)
    a, b = (quality_pu.classify(docs, x, fold("doc_id", 4) == 2).toPandas().sort_values("doc_id")
            for x in (labels, flipped))
    pd.testing.assert_series_equal(a["score"], b["score"], check_exact=False, rtol=1e-6)


def test_scorer_equals_classify(spark):
    texts, _, labels = quality_tables(spark, 80)
    docs = documents(spark, texts + [None])
    measures = stage(quality_pu.measured(docs, "doc_id"))
    model = quality_pu.fit(measures, labels, F.lit(True))
    a = {r[0]: r[1] for r in docs.select("doc_id", quality_pu.scorer(model)("text")).collect()}
    b = {r.doc_id: r.score for r in quality_pu.score_measures(measures, model).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in a)
