"""Substring and near-duplicate removal against brute force, and star contraction."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casebook.llm import simhash_gray, substring_dedup
from casebook.llm.components import components

from .helpers import awkward_texts, documents


def passages(seed=5):
    """Texts with shared passages, inner repeats, periodic runs and near copies."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    shared = [say(n) for n in (12, 20, 36, 55, 90)]
    texts = []
    for _ in range(60):
        words = say(rnd.randint(0, 50))
        for _ in range(rnd.randint(0, 3)):
            own = list(rnd.choice(shared))
            if rnd.random() < 0.5:
                own[rnd.randrange(len(own))] = "edit"
            words += own + say(rnd.randint(0, 25))
        texts.append(" ".join(words))
    base = say(80)
    texts += [" ".join(base), " ".join(base), " ".join(base[:79] + ["x"]), "a " * 90, "a b " * 60,
              " ".join(say(3) * 30), " ".join(base + base)]
    return texts + [None, "", " \n ", "one\x0btwo three"]


def brute_removed(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone), gone))
    return out


@pytest.mark.parametrize("window,anchor", [(12, 3), (35, 8)])
def test_removed_words_equal_brute_force(spark, window, anchor):
    texts = passages()
    rows = substring_dedup.remove_repeats(documents(spark, texts), window, anchor).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for i, (n, gone, kept, places) in enumerate(brute_removed(texts, window)):
        assert (got[i].n_words, got[i].n_removed, bytes(got[i].kept)) == (n, gone, kept), texts[i]
        assert {p for s in got[i].spans for p in range(s["first"], s["after"])} == places


def test_repeated_rows_and_null_ids_are_places_of_their_own(spark):
    text = " ".join(f"q{i}" for i in range(40))
    docs = documents(spark, [text, text, "z " + text, "short"], ids=[1, 1, None, None])
    rows = substring_dedup.remove_repeats(docs, 35, 8, carry=("text", "key")).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.carried.key) for r in rows) == [
        ("1", 40, 1), ("1", 40, 1), ("None", 0, 1), ("None", 40, 1)]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_marks_of_many_repeated_rows_are_bounded_by_one_text(spark, monkeypatch):
    text = " ".join(f"q{i}" for i in range(200))
    docs = documents(spark, [text] * 300 + ["z " + text], ids=[None] * 200 + [7] * 100 + [8])
    sizes, cut = [], substring_dedup._cut

    def watched(held, *rest):
        sizes.extend(r[0] for r in held.select(F.size("list")).collect())
        return cut(held, *rest)

    monkeypatch.setattr(substring_dedup, "_cut", watched)
    rows = substring_dedup.remove_repeats(docs, 35, 8).collect()
    assert len(sizes) == 301 and max(sizes) <= 200 - 35 + 1
    assert sorted(r.n_removed for r in rows) == [200] * 301


def brute_components(fingerprints, limit):
    ids = list(fingerprints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and bin(fingerprints[a] ^ fingerprints[b]).count("1") <= limit:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def plain_simhash(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    parts = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or (
        [b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("leaf_size", [4, 2048])
def test_components_equal_brute_force(spark, leaf_size):
    texts = awkward_texts(n=60) + passages()
    rnd = random.Random(2)
    long = [f"t{i}" for i in range(400)]
    for _ in range(30):
        own = list(long)
        own[rnd.randrange(400)] = "ÀA"
        texts.append(" ".join(own))
    rows = simhash_gray.near_duplicates(documents(spark, texts), 3, 2, leaf_size).collect()
    want = {i: plain_simhash(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in rows} == want
    assert {r.doc_id: r.component_id for r in rows} == brute_components(want, 2)


def test_spark_hash_is_the_contract_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ab c"))).first()[0] & (1 << 64) - 1 == \
        xxhash.xxh64_intdigest(b"ab c", 42)


def test_null_ids_and_repeated_rows(spark):
    rows = simhash_gray.near_duplicates(documents(spark, ["a b c d", "a b c d", "a b c d", "zz"],
                                                  ids=[4, 4, None, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [
        ("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash_gray.near_duplicates(documents(spark, ["a"]).limit(0)).count() == 0


def test_gray_tree_finds_all_pairs():
    rng = np.random.default_rng(4)
    codes = np.unique(np.r_[rng.integers(0, 1 << 63, 500, dtype=np.uint64),
                            np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))])
    tree = simhash_gray.GrayTree(codes, np.full(len(codes), simhash_gray.FULL))
    for limit in (0, 2, 5):
        q, m = tree.search(codes, limit)
        far = np.bitwise_count(codes[:, None] ^ codes[None, :])
        assert set(zip(q.tolist(), m.tolist())) == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(far <= limit)))))


def test_gray_rank_orders_neighbours():
    codes = np.arange(256, dtype=np.uint64)
    ordered = codes[np.argsort(simhash_gray.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_star_contraction(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    out = {r.a: r.b for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {95: 90, 100: 90, 201: 200}
    assert out == want
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_digest_of_kept_words(spark):
    row = substring_dedup.remove_repeats(documents(spark, ["é  b\tc"])).select(F.sha2("kept", 256)).first()
    assert row[0] == hashlib.sha256("é b c".encode()).hexdigest()


def test_bits_of_long_texts_come_in_parts(monkeypatch):
    texts = [(t or "").encode() for t in awkward_texts(n=20) + passages()]
    want = [plain_simhash(t.decode()) for t in texts]
    for part in (7, 100, 10 ** 6):
        monkeypatch.setattr(simhash_gray, "BITS_AT_ONCE", part)
        assert simhash_gray.fingerprints(texts).tolist() == want
    assert simhash_gray.fingerprints([]).tolist() == []
