"""Approximate nearest neighbours by multi-index hashing (operator 6).

Vectors are normalised, rotated by ``ROTATIONS`` learned orthogonal matrices (iterative
quantisation on a bounded sample of ``SAMPLE`` vectors, each from another start) and reduced to
their sign bits: 256 bits for 64 components.  A code is split into ``SUBSTRINGS`` parts and every
part has its own index (distinct value -> rows).  A code within Hamming radius R of the query
is within R / 2 bits of it in the first part or within R - 1 - R / 2 in the second (pigeonhole),
so the values that near in either index retrieve every code within R; those within R in full
are reranked by exact cosine on the original vectors.

R is learned from the sample: the ``RADIUS_SHARE`` quantile of the code distance between a
sample vector and its nearest sample neighbours (neighbours are nearer in the full table,
so the radius errs to the safe side).  Nearest neighbours of the tables at hand are 60 to 70
degrees apart, so R is 40 % of the bits.  At such radii a part has far more values within reach than
rows, so an index is probed by comparing its values (a few bit operations each), not by listing
the values in reach.  Long parts are what makes the probe selective: 9 % of the rows are
candidates, 5 to 7 % are reranked, where eight 8-bit parts of one rotation retrieved 95 % and
reranked 35 %.

Where a tile holds fewer than k codes within R the radius grows until k are found, so a query
always gets min(k, candidates) rows.  All rows are indexed, in blocks.  Vectors that are null,
empty, zero, or hold null or non-finite components take no part; ties go to the smaller vec_id;
repeated rows are candidates of their own.  Vectors whose length is not the sample's usual one
are compared with all of their length.  An empty table gives no rows; extra columns, whatever
their names, are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.vector_blocks import search, usable

SAMPLE = 2048
ROUNDS = 25
RADIUS_SHARE = 0.985
ROTATIONS, SUBSTRINGS = 4, 2


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_rotations(sample: np.ndarray, number: int = ROTATIONS, rounds: int = ROUNDS) -> np.ndarray:
    """Orthogonal matrices, side by side, that bring the sample near to its sign vectors."""
    dim, found = sample.shape[1], []
    for i in range(number):
        rotation = np.linalg.qr(np.random.default_rng(5 + i).standard_normal((dim, dim)))[0]
        for _ in range(rounds):
            signs = np.where(sample @ rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(sample.T @ signs)
            rotation = u @ vt
        found.append(rotation)
    return np.concatenate(found, axis=1)


def codes(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Sign bits as 64-bit words, the same number of them in every part (unused bits are 0)."""
    bits = np.packbits(vectors @ rotations >= 0, axis=1)
    width = 8 * SUBSTRINGS
    padded = np.zeros((len(bits), -(-bits.shape[1] // width) * width), dtype=np.uint8)
    padded[:, :bits.shape[1]] = bits
    return padded.view(np.uint64)


def distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Differing bits of each (query, row); word by word, so that nothing larger is held."""
    out = np.zeros((len(q), len(r)), dtype=np.uint16)
    for a, b in zip(q.T, r.T):
        out += np.bitwise_count(a[:, None] ^ b[None, :])
    return out


def learn_radius(sample: np.ndarray, rotations: np.ndarray, k: int) -> int:
    near = sample @ sample.T
    np.fill_diagonal(near, -2.0)
    k = min(k, len(sample) - 1)
    if k < 1:
        return rotations.shape[1]
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    words = codes(sample, rotations)
    far = np.bitwise_count(words[:, None, :] ^ words[top]).sum(axis=2)
    return int(np.quantile(far, RADIUS_SHARE))


class CodeIndex:
    """The codes of a tile of rows, with an index per part: distinct values and each row's value."""

    def __init__(self, words: np.ndarray):
        self.words, self.parts = words, []
        width = words.shape[1] // SUBSTRINGS
        for s in range(SUBSTRINGS):
            values, of = np.unique(words[:, s * width:(s + 1) * width], axis=0, return_inverse=True)
            self.parts.append((slice(s * width, (s + 1) * width), values, of.ravel()))

    def probe(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Candidate matrix (queries x rows): a superset of the codes within ``radius``."""
        found = np.zeros((len(q), len(self.words)), dtype=bool)
        left = radius - (SUBSTRINGS - 1)             # reaches of the parts, one less each but the first
        for i, (own, values, of) in enumerate(self.parts):
            reach = left // SUBSTRINGS + (i < left % SUBSTRINGS)
            if reach >= 0:
                found |= (distances(q[:, own], values) <= reach)[:, of]
        return found

    def within(self, q: np.ndarray, other: np.ndarray, radius: int, k: int) -> np.ndarray:
        """All rows within Hamming ``radius`` of each query; for queries with fewer than ``k`` of
        them the radius grows."""
        out, left, bits = np.zeros(other.shape, dtype=bool), np.arange(len(q)), 64 * self.words.shape[1]
        enough = np.minimum(k, other.sum(axis=1))
        while len(left):
            a, b = np.nonzero(self.probe(q[left], radius) & other[left])
            near = np.bitwise_count(q[left[a]] ^ self.words[b]).sum(axis=1) <= radius
            out[left[a[near]], b[near]] = True
            if radius >= bits:
                break
            left = left[out[left].sum(axis=1) < enough[left]]
            radius += max(1, bits // 32)
        return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the ``k`` nearest rows found per query."""
    rows = usable(vectors, require_length=True)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    sample = [np.array(x["v"]) for x in picked]
    dims = [len(x) for x in sample]
    dim = max(set(dims), key=dims.count) if dims else 0
    # the radius is learned for the usual length; vectors of other lengths are probed in full
    usual = unit(np.stack([x for x in sample if len(x) == dim])) if dims else np.zeros((0, 0))
    rotations = learn_rotations(usual) if dims else None
    radius = learn_radius(usual, rotations, k) if dims else 0

    def prepare(ri, r):
        ru = unit(r)
        index = CodeIndex(codes(ru, rotations)) if r.shape[1] == dim else None

        def best(qi, q):
            qu = unit(q)
            other = qi[:, None] != ri[None, :]
            found = index.within(codes(qu, rotations), other, radius, k) if index else other
            out_a, out_b, out_s = [], [], []
            for i in range(len(qi)):
                b = np.flatnonzero(found[i])
                s = (ru[b] * qu[i]).sum(axis=1)
                take = np.lexsort((ri[b], -s))[:k]
                out_a.append(np.full(len(take), i))
                out_b.append(b[take])
                out_s.append(s[take])
            return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_s)

        return best

    return search(rows, is_query, k, "double", prepare)
