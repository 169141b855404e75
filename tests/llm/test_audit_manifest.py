"""Merkle manifest, MinHash near-dedup and filter audit against brute force."""
import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casebook.llm import filter_audit, merkle_jump, minhash_oph
from casebook.llm.word_arrays import TextBytes, word_array

from .helpers import awkward_texts, documents
from .test_dedup import passages


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- words as arrays

def test_words_as_arrays_equal_split():
    texts = [t or "" for t in awkward_texts()] + ["", "a", " a", "a ", "ab\tc\r\n\x0b\x0c d", "\x1c\u0085x"]
    column = pa.array(["skipped", *texts]).slice(1)                # an offset into the buffers
    for lower in (False, True):
        words, row = word_array(TextBytes(column, lower=lower))
        got = [[] for _ in texts]
        for w, r in zip(words.to_pylist(), row.tolist()):
            got[r].append(w)
        plain = [t.encode() for t in texts]
        assert got == [(t.lower() if lower else t).split() for t in plain]


def test_no_words_at_all():
    words, row = word_array(TextBytes(pa.array([], pa.string())))
    assert len(words) == len(row) == 0


# ---------------------------------------------------------------- manifest

def plain_tree(nodes):
    """Levels of the tree over hex digests, and the siblings on each node's way up."""
    ways = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            s = p ^ 1
            ways[i].append(None if s >= len(nodes) else (s < p, nodes[s]))
        nodes = [sha("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
        place = [p // 2 for p in place]
    return nodes[0], ways


def plain_manifest(rows, tampered):
    def leaf(r, add=0):
        n = None if r["n_chars"] is None else r["n_chars"] + add
        fields = [r["doc_id"], r["source"], r["lang"], n, r["text"]]
        return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    parts = {}
    for r in rows:
        parts.setdefault(r["lang"], []).append(r)
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for p in order:
        own = sorted(parts[p], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[p] = (own, *plain_tree([leaf(r) for r in own]))
    root, tops = plain_tree([trees[p][1] for p in order])
    out = []
    for k, p in enumerate(order):
        own, subroot, ways = trees[p]
        for r, way in zip(own, ways):
            way = way + tops[k]
            now = leaf(r, 1) if tampered(r) else leaf(r)
            for s in way:
                now = sha(now if s is None else s[1] + now if s[0] else now + s[1])
            out.append((r["doc_id"], leaf(r), subroot, root, sha("".join(s[1] for s in way if s)), now, now == root))
    return sorted(out, key=str)


def manifest(docs, **options):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle_jump.manifest(docs, hit, {"n_chars": F.try_add("n_chars", F.lit(1))}, **options)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.p, r.folded_root, r.folded_root == r.root)
                   for r in out.withColumn("p", merkle_jump.siblings_digest(F.col("proof"))).collect()), key=str)


def hit(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0


@pytest.mark.parametrize("sizes", [(1,), (2,), (5, 1), (3, 1, 1, 70), (33, 17, 8, 1, 2, 64, 9)])
def test_manifest_equals_brute_force(spark, sizes):
    langs = [None, "de", "", "en", "ß", "Z", "zz"]
    texts = awkward_texts(n=220)
    at, rows = 0, []
    for lang, n in zip(langs, sizes):
        rows += [(i, texts[i], lang) for i in range(at, at + n)]
        at += n
    random.Random(1).shuffle(rows)
    docs = documents(spark, [r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows])
    assert manifest(docs) == plain_manifest([r.asDict() for r in docs.collect()], hit)


def test_manifest_over_several_blocks(spark):
    """Blocks of two levels: the trees grow in several rounds, as those of large tables do."""
    docs = documents(spark, [f"t{i}" for i in range(150)], langs=["en" if i % 5 else "fr" for i in range(150)])
    assert manifest(docs, block_levels=2) == plain_manifest([r.asDict() for r in docs.collect()], hit)


def test_manifest_of_null_and_repeated_ids(spark):
    texts = ["a", "a", "b", None, "", "same", "same", "same"]
    docs = documents(spark, texts, [None, None, 7, 7, 7, 4, 4, 4], [None, "en", "en", "en", "en", "en", "en", "en"])
    got = manifest(docs)
    assert got == plain_manifest([r.asDict() for r in docs.collect()], hit)
    assert len(got) == len(texts)
    assert manifest(docs.limit(0)) == []


def test_a_change_shows_in_every_field(spark):
    docs = documents(spark, ["x", "y", "z"])
    for field, other in (("text", F.lit("?")), ("source", F.lit(None).cast("string")), ("n_chars", F.lit(9))):
        out = merkle_jump.manifest(docs, F.col("doc_id") == 1, {field: other})
        assert {r.doc_id: r.folded_root == r.root for r in out.collect()} == {0: True, 1: False, 2: True}


# ---------------------------------------------------------------- near duplicates

def plain_sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    return out


def plain_components(texts, percent):
    sets = plain_sets(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(seed, n, group):
    """Copies of a base text with 0 to 12 words of their own each: a hub with many spokes, whose
    spokes mostly do not link with each other."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"b{rnd.randrange(900)}" for _ in range(150)]
        for k in range(group):
            words = list(base)
            for _ in range(rnd.randint(0, 12)):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(10 ** 6)}"
            out.append(" ".join(words))
        chain = list(base)                      # links hand to hand, away from the base
        for k in range(12):
            at = 10 + 9 * k
            chain[at:at + 3] = [f"c{rnd.randrange(10 ** 6)}" for _ in range(3)]
            out.append(" ".join(chain))
    return out


@pytest.mark.parametrize("texts", [passages(), edited(3, 3, 60), awkward_texts()])
def test_components_equal_brute_force(spark, texts):
    got = {r.doc_id: r for r in minhash_oph.near_duplicates(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, (n, least) in enumerate(plain_components(texts, 85)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, least, i == least), texts[i]


def test_links_beside_the_centre_are_found_from_differences(spark):
    """All members under one centre, whatever the buckets: the differences alone must find the links
    between members."""
    texts = edited(8, 1, 50)
    sets = plain_sets(texts)
    sizes = [len(s) for s in sets]
    hub = 0
    code = {s: i for i, s in enumerate(sorted(set().union(*sets)))}

    def linked(i, j):
        k = len(sets[i] & sets[j])
        return 100 * k >= 85 * (sizes[i] + sizes[j] - k)

    members = [i for i in range(len(texts)) if i != hub]
    rows = [(hub, i, sizes[hub], sizes[i], [code[s] for s in sets[i] - sets[hub]],
             [code[s] for s in sets[hub] - sets[i]], hub, hub if linked(hub, i) else i) for i in members]
    stars = spark.createDataFrame(rows, "a long, x long, na int, nx int, added array<long>, lost array<long>, "
                                        "root_a long, root_x long")
    found = {tuple(sorted((r.a, r.b))) for r in minhash_oph._beside_the_centre(stars, 85).collect()}
    assert all(linked(*p) for p in found)

    def components(pairs):
        root = {i: i for i in range(len(texts))}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for i, j in pairs:
            a, b = sorted((find(i), find(j)))
            root[b] = a
        return [find(i) for i in range(len(texts))]

    spokes = [(hub, i) for i in members if linked(hub, i)]
    every = [(i, j) for i in range(len(texts)) for j in range(i) if linked(i, j)]
    assert components(spokes) != components(every)                 # there is something to find
    assert components(spokes + sorted(found)) == components(every)


def test_null_and_repeated_ids_of_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(90))
    texts = [text, text, text + " x", "", None, " \n", "one two", "ONE two", "other words here"]
    docs = documents(spark, texts, [None, 5, 5, None, 3, 4, None, None, None])
    got = minhash_oph.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    want = [(None, 88, 5, False), (5, 88, 5, True), (5, 89, 5, True), (None, 0, None, False), (3, 0, 3, True),
            (4, 0, 4, True), (None, 1, None, False), (None, 1, None, False), (None, 1, None, False)]
    assert Counter(map(tuple, got)) == Counter(want)
    assert minhash_oph.near_duplicates(docs.limit(0)).count() == 0


def test_densified_bins_agree_as_often_as_the_sets():
    rng = np.random.default_rng(0)
    agree = []
    for n in (6, 40, 400):
        for _ in range(200):
            common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            own = rng.integers(0, 1 << 63, (2, max(1, n // 6)), dtype=np.uint64)
            a, b = np.r_[common, own[0]], np.r_[common, own[1]]
            owner = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
            s = minhash_oph.signatures(owner, np.r_[a, b], 2)
            agree.append((s[0] == s[1]).mean() - n / (n + 2 * max(1, n // 6)))
    assert abs(np.mean(agree)) < 0.01


# ---------------------------------------------------------------- filter audit

def plain_audit(rows, good, toxic):
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    failed = []
    for r in rows:
        t = r["text"] or ""
        w = t.encode().split()
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
             "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t),
             "E": r["doc_id"] is not None and least[t] < r["doc_id"]}
        failed.append((r["lang"] or "", {k for k, v in f.items() if v}, r["doc_id"]))
    out = Counter()
    shapley = Counter()
    for part in {f[0] for f in failed}:
        own = [f for f in failed if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                out[part, order, step] = (
                    len(left), len(gone), sum(letter in f[1] for f in own) - len(gone),
                    sum(f[1] == {letter} for f in own), sum(f[2] in good for f in gone),
                    sum(f[2] in toxic for f in gone))
                shapley[part, letter] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}


def test_audit_equals_brute_force(spark):
    rnd = random.Random(2)
    texts = awkward_texts(n=60) + ["# " + " ".join(f"v{i}" for i in range(120)), "LOUD TEXT", "LOUD TEXT", ""]
    texts += [" ".join(f"v{rnd.randrange(400)}" for _ in range(rnd.choice((99, 100, 101, 300)))) for _ in range(30)]
    texts += [" ".join(["x"] * 20 + [f"y{i}" for i in range(n)]) for n in (79, 80, 81, 76)]
    ids = [None if i % 17 == 0 else i // 2 for i in range(len(texts))]
    langs = [rnd.choice(["en", "de", None, ""]) for _ in texts]
    docs = documents(spark, texts, ids, langs)
    marks = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(0, 60)]
    marks += [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, part string")
    good = {m[0] for m in marks if m[1] == 1 and m[0] is not None}
    toxic = {m[0] for m in marks if m[2] == 1 and m[0] is not None}
    got = audited(docs, labels)
    assert got == plain_audit([r.asDict() for r in docs.collect()], good, toxic)
    assert audited(docs.limit(0), labels) == {}


def test_audit_without_words_or_labels(spark):
    docs = documents(spark, [None, "", " "], [1, 2, 3], ["en"] * 3)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audited(docs, labels)
    assert got == plain_audit([r.asDict() for r in docs.collect()], set(), set())
    assert got["en", "EABCD", 1][:2] == (2, 1)


def test_matrix_rows_and_columns(spark):
    """The shards' columns name the same words everywhere, with their counts."""
    texts = ["b a b", "", "c a", "zz"]
    docs = documents(spark, texts).repartition(3).select(
        "doc_id", "text", F.lit("p").alias("part"), F.lit(b"d").alias("digest"))
    found = {}
    for s in filter_audit.matrix(docs).collect():
        ids = filter_audit.global_columns(s.n_words, [x.asDict() for x in s.column_ids or []])
        cols, at = filter_audit.columns_of(bytes(s.cols), s.n_words), 0
        counts = filter_audit.counts_of(bytes(s.counts), len(cols))
        for doc, n in zip(s.doc_id, np.frombuffer(s.row_words, "<i4").tolist()):
            found[doc] = dict(zip(ids[cols[at:at + n]].tolist(), counts[at:at + n].tolist()))
            at += n
    for doc, text in enumerate(texts):        # one number per word, the same in every shard
        assert sorted(found[doc].values()) == sorted(Counter(text.split()).values())
    assert len(set(found[0]) & set(found[2])) == 1
    assert len({i for row in found.values() for i in row}) == len({w for t in texts for w in t.split()})


def test_matrix_shares_numbers_between_shards(spark):
    texts = [f"common w{i} w{i % 3}" for i in range(12)]
    docs = documents(spark, texts).repartition(4).select(
        "doc_id", "text", F.lit("p").alias("part"), F.lit(b"d").alias("digest"))
    rows, shards = {}, set()
    for s in filter_audit.matrix(docs).collect():
        ids = filter_audit.global_columns(s.n_words, [x.asDict() for x in s.column_ids])
        cols, at = filter_audit.columns_of(bytes(s.cols), s.n_words), 0
        for doc, n in zip(s.doc_id, np.frombuffer(s.row_words, "<i4").tolist()):
            rows[doc] = set(ids[cols[at:at + n]].tolist())
            at += n
        shards.add(s.shard)
    assert len(shards) > 1 and len(set.intersection(*rows.values())) == 1
    words = {w for t in texts for w in t.split()}
    assert len(set.union(*rows.values())) == len(words)
    for i in range(12):
        for j in range(12):
            assert len(rows[i] & rows[j]) == len(set(texts[i].split()) & set(texts[j].split()))
