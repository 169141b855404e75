"""Exact top-k and nearest neighbours against brute force."""
import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.llm import ann_mih, topk_taat
from casebook.llm.vector_blocks import search, usable

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()),
                       T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("score", T.DoubleType()),
                       T.StructField("qb", T.IntegerType())])


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 0.5, 1) for i, v in vectors], SCHEMA)


def awkward(n=120, dim=16, seed=1):
    rnd = random.Random(seed)
    out = [(i, [float(np.float32(rnd.gauss(0, 0.3))) for _ in range(dim)]) for i in range(n)]
    out += [(n + i, out[5][1]) for i in range(30)]                       # a group of copies
    out += [(500, None), (520, []), (540, [float("nan")] * dim), (560, [None] + [1.0] * (dim - 1)),
            (580, [float("inf")] * dim), (600, [0.0] * dim), (None, [1.0] * dim), (620, [1.0, 2.0])]
    out += [out[7], out[20]]                                             # repeated rows
    return out


def brute_ip(vectors, every, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, qv in sorted(good):
        if q % every or q in want:
            continue
        scored = [(-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv)]
        want[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return want


def test_topk_equals_brute_force(spark):
    vectors = awkward()
    rows = topk_taat.top_k(table(spark, vectors), F.col("vec_id") % 20 == 0, k=20).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: v for q, v in brute_ip(vectors, 20, 20).items() if v}
    assert got == want
    assert topk_taat.top_k(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_do_not_change_the_result(spark):
    rows = usable(table(spark, awkward()), False).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * 64).cast("long")).alias("v"))

    def prepare(ri, r):
        postings = topk_taat.Postings(r)

        def best(qi, q):
            s = postings.scores(q)
            s[qi[:, None] == ri[None, :]] = topk_taat.OWN
            a, b = topk_taat.top_of_block(s, ri, 4)
            keep = s[a, b] != topk_taat.OWN
            return a[keep], b[keep], s[a, b][keep]

        return best

    runs = [sorted(map(tuple, search(rows, F.col("vec_id") % 20 == 0, 4, "long", prepare, rb, rt, qt).collect()))
            for rb, rt, qt in ((1000, 1000, 1000), (17, 5, 3))]
    assert runs[0] == runs[1]


def test_scores_of_large_weights_are_exact():
    rng = np.random.default_rng(5)
    for size in (100, 1 << 20, 1 << 29):
        q, r = rng.integers(-size, size, (5, 8)), rng.integers(-size, size, (9, 8))
        r[:, 3] = 0
        r[1:, 4] = 0
        want = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in r] for x in q]
        assert topk_taat.Postings(r).scores(q).tolist() == want


def test_nearest_recall_order_and_ties(spark):
    vectors = awkward(n=400)
    rows = ann_mih.nearest(table(spark, vectors), F.col("vec_id") % 50 == 0, k=5).collect()
    good = {}
    for i, v in vectors:
        if i is not None and v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v))
    hit = total = 0
    for q in [i for i in good if i % 50 == 0]:
        a = good[q][0]
        scored = sorted((-round(float(a @ v / np.linalg.norm(a) / np.linalg.norm(v)), 12), i)
                        for i, vs in good.items() if i != q for v in vs)[:5]
        own = sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        assert all(x[2] >= y[2] for x, y in zip(own, own[1:]))
        hit += len({r[1] for r in own} & {i for _, i in scored})
        total += 5
    assert hit / total >= 0.9
    assert not {r.query_id for r in rows} & {500, 520, 540, 560, 580, 600}
    assert ann_mih.nearest(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    words = lambda n: rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
    r = words(300)
    r[100:150] = r[:50] ^ (np.uint64(1) << rng.integers(0, 60, (50, 4)).astype(np.uint64))
    q = np.concatenate([r[:10], words(10)])
    other = np.ones((20, 300), dtype=bool)
    far = ann_mih.distances(q, r)
    index = ann_mih.CodeIndex(r)
    for radius in (0, 1, 4, 9, 90, 109, 120, 255):
        assert (index.within(q, other, radius, k=0) == (far <= radius)).all()
        assert (index.probe(q, radius) >= (far <= radius)).all()
    assert (index.within(q, other, 0, k=5).sum(axis=1) >= 5).all()


def test_the_index_prunes(spark):
    """Candidates and reranked rows are a small share, with the recall kept."""
    table_ = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = ann_mih.unit(np.array([r.embedding for r in table_.orderBy("vec_id").collect()], dtype=float))
    rotations = ann_mih.learn_rotations(x[::2])
    radius = ann_mih.learn_radius(x[::2], rotations, 5)
    words, some = ann_mih.codes(x, rotations), np.arange(0, len(x), 50)
    index = ann_mih.CodeIndex(words)
    candidates = index.probe(words[some], radius)
    near = ann_mih.distances(words[some], words) <= radius
    cosine = x[some] @ x.T
    cosine[np.arange(len(some)), some] = -2
    top = np.argsort(-cosine, axis=1)[:, :5]
    assert candidates.mean() < 0.2 and near.mean() < 0.1
    assert np.mean([near[i, t].mean() for i, t in enumerate(top)]) > 0.95
