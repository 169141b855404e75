"""SimHash near-dedup with a Gray-order hierarchical index (operator 8).

A text's fingerprint has bit b set when more than half of its shingle hashes have it.
Equal fingerprints meet first (one row per fingerprint from here on).  The distinct
fingerprints are cut into leaves, each a range of Gray rank: counts of 16-bit prefixes (at
most 65536 rows) come to the driver, a prefix with more than ``leaf_size`` fingerprints is
split bit by bit (by further counts, 4 bits at a time: 16 rows for each heavy prefix), so no
leaf is hot whatever the data.  A
range of Gray rank that is a leaf shares its leading bits.

The index factors what its members share: members are sorted by Gray rank, every ``FAN``
neighbours get a node whose mask marks the bits they all agree on, every ``FAN`` nodes an
upper node, and so on.  A search walks down from the top, adds up the differing bits under
each mask (bits already counted above are left out) and prunes a whole group as soon as the
sum passes the limit.  The same index serves twice: over the leaves, to find which leaves a
fingerprint must visit, and inside each leaf, to find the links.

A fingerprint visits leaves that are deeper than its own, or equally deep and later, so a
pair is found once, and a leaf of depth d gets at most (1 + d + d(d-1)/2) * leaf_size
visitors.  A leaf returns a spanning star per connected group, not all pairs; components
then come from star contraction.  Fingerprints that are no text's own never appear.

Null and empty texts have fingerprint 0 and link like others.  Repeated rows share a
component.  Null ids never name a component (it is null if all ids are null).  An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import batches_of, chunks, reach_workers, row_key, stage
from casebook.llm.components import components

LEAF_SIZE = 2048
#: Leaves sent to the executors: 16 bytes each.  Leaves keep their size up to MAX_LEAVES / 2 of them
#: (10^9 distinct fingerprints) and only grow beyond.
MAX_LEAVES = 1 << 20
#: Bits that the first count of prefixes looks at, and by which heavy prefixes are then extended.
FIRST_BITS, MORE_BITS = 16, 4
FAN = 16
#: Shingle hashes whose bits are spread out together (64 bytes each).
BITS_AT_ONCE = 200_000
U = np.uint64
FULL = U(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: list[bytes], size: int, seed: int) -> list[int]:
    if len(words) > size:
        parts = zip(*(words[i:] for i in range(size)))
        return [xxhash.xxh64_intdigest(b" ".join(p), seed) for p in parts]
    return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []


def fingerprints(texts: list[bytes], size: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: ASCII lower case, words split at \\x20 and \\x09-\\x0D."""
    hashes = [shingle_hashes(t.lower().split(), size, seed) for t in texts]
    n = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
    out = np.zeros(len(texts), dtype=U)
    some = np.flatnonzero(n)
    sums = np.zeros((len(texts), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), n)
    flat = np.fromiter((h for hs in hashes for h in hs), dtype=">u8", count=int(n.sum()))
    for at in range(0, len(flat), BITS_AT_ONCE):     # a very long text comes in several parts
        part, own = flat[at:at + BITS_AT_ONCE], owner[at:at + BITS_AT_ONCE]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sums[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    if len(some):
        major = np.packbits(2 * sums[some] > n[some][:, None], axis=1)
        out[some] = major.view(">u8").ravel().astype(U)
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of a code in the reflected Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(shift)
    return rank


class GrayTree:
    """Masked patterns in Gray order under nodes that hold what their members share."""

    def __init__(self, codes: np.ndarray, masks: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        code, mask = codes[self.order], masks[self.order]
        self.levels = [(code, mask)]
        while len(code) > FAN:
            cuts = np.arange(0, len(code), FAN)
            same = ~(np.bitwise_or.reduceat(code, cuts) ^ np.bitwise_and.reduceat(code, cuts))
            mask = np.bitwise_and.reduceat(mask, cuts) & same
            code = code[cuts] & mask
            self.levels.append((code, mask))

    def search(self, asked: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``asked``, place in the codes) of all pairs that differ in at most
        ``limit`` of the masked bits."""
        code, mask = self.levels[-1]
        q = np.repeat(np.arange(len(asked)), len(code))
        node = np.tile(np.arange(len(code)), len(asked))
        seen = np.zeros(len(q), dtype=U)
        sum_ = np.zeros(len(q), dtype=np.uint8)
        for depth in range(len(self.levels) - 1, -1, -1):
            code, mask = self.levels[depth]
            sum_ = sum_ + np.bitwise_count((asked[q] ^ code[node]) & mask[node] & ~seen)
            near = sum_ <= limit
            q, node, sum_ = q[near], node[near], sum_[near]
            if depth:
                seen = np.repeat(mask[node], FAN)
                below = (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, sum_ = np.repeat(q, FAN), np.repeat(sum_, FAN)
                real = below < len(self.levels[depth - 1][0])
                q, node, sum_, seen = q[real], below[real], sum_[real], seen[real]
        return q, self.order[node]


def leaf_masks(depth: np.ndarray) -> np.ndarray:
    return np.where(depth > 0, FULL << (U(64) - np.maximum(depth, 1).astype(U)), U(0))


def plan_leaves(distinct: DataFrame, leaf_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (left-aligned) and depths of the leaves, in binary order: prefixes with at most
    ``leaf_size`` fingerprints, none shorter than needed.  A round of counts has at most
    2^MORE_BITS rows for each prefix that holds more than ``leaf_size`` of the fingerprints."""
    patterns, depths = [], []
    heavy, parent_depth = {0: None}, 0
    while heavy:
        width = parent_depth + (MORE_BITS if parent_depth else FIRST_BITS)
        code = F.shiftrightunsigned("fp", 64 - width) if width < 64 else F.col("fp")
        rows = distinct.select(code.alias("p"))
        if parent_depth:
            up = distinct.sparkSession.createDataFrame([(x,) for x in heavy], "up long")
            rows = (distinct.select(code.alias("p"),
                                    F.shiftrightunsigned("fp", 64 - parent_depth).alias("up"))
                    .join(F.broadcast(up), "up"))     # at most MAX_LEAVES prefixes
        counts = {int(r["p"]) & (1 << 64) - 1: r["n"]
                  for r in rows.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
        by_depth = {width: counts}
        for d in range(width - 1, parent_depth - 1, -1):
            level: dict[int, int] = {}
            for p, n in by_depth[d + 1].items():
                level[p >> 1] = level.get(p >> 1, 0) + n
            by_depth[d] = level
        deeper = {}
        stack = [(p, parent_depth) for p in by_depth[parent_depth]]
        while stack:
            p, d = stack.pop()
            n = by_depth[d].get(p, 0)
            if not n:
                continue
            if n <= leaf_size or d == 64:
                patterns.append(p << (64 - d) if d else 0)
                depths.append(d)
            elif d == width:
                deeper[p if p < 1 << 63 else p - (1 << 64)] = None
            else:
                stack += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        heavy, parent_depth = deeper, width
    order = np.argsort(np.array(patterns, dtype=U))
    return np.array(patterns, dtype=U)[order], np.array(depths, dtype=np.int64)[order]


def _route(distinct: DataFrame, patterns: np.ndarray, depths: np.ndarray, limit: int) -> DataFrame:
    """(leaf, fp, own): every fingerprint in its leaf and in the leaves it must visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = GrayTree(patterns, leaf_masks(depths))
        for batch in batches_of(batches):
            for at in range(0, batch.num_rows, 2048):
                fp = batch.column("fp").slice(at, 2048).to_numpy(zero_copy_only=False).view(U)
                home = np.searchsorted(patterns, fp, side="right") - 1
                q, leaf = tree.search(fp, limit)
                own = leaf == home[q]
                go = own | (depths[leaf] > depths[home[q]]) | (
                    (depths[leaf] == depths[home[q]]) & (leaf > home[q]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[go].astype(np.int32)), pa.array(fp[q[go]].view(np.int64)),
                     pa.array(own[go])], names=["leaf", "fp", "own"])

    return distinct.select("fp").mapInArrow(run, "leaf int, fp long, own boolean")


def spanning_stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node of the connected group of each of ``n`` nodes."""
    root = np.arange(n)
    while len(a):
        least = np.minimum(root[a], root[b])
        if (root[a] == root[b]).all():
            break
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
    return root


def _leaf_links(limit: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["own", "fp"], ascending=False)
        code = part["fp"].to_numpy().view(U)
        members = int(part["own"].sum())
        tree = GrayTree(code[:members], np.full(members, FULL))
        a, b = [], []
        for at in range(0, len(code), 1024):
            q, m = tree.search(code[at:at + 1024], limit)
            a.append(q + at)
            b.append(m)
        root = spanning_stars(len(code), np.concatenate(a), np.concatenate(b))
        hung = np.flatnonzero(root != np.arange(len(code)))
        return pd.DataFrame({"a": code[hung].view(np.int64), "b": code[root[hung]].view(np.int64)})

    return run


def links(distinct: DataFrame, limit: int, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints connected by pairs that differ in
    at most ``limit`` bits.  ``distinct`` has distinct fingerprints ``fp`` (staged)."""
    n = distinct.count()
    patterns, depths = plan_leaves(distinct, max(leaf_size, -(-2 * n // MAX_LEAVES)))
    if not n:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    routed = _route(distinct, patterns, depths, limit)
    return routed.groupBy("leaf").applyInPandas(_leaf_links(limit), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 2,
                    leaf_size: int = LEAF_SIZE) -> DataFrame:
    """doc_id, key, fp (64 bits as a long), component_id and root (a fingerprint that names the
    component) of every document; ``key`` tells rows apart (``row_key``)."""
    reach_workers(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for part in chunks(batch):
                fp = fingerprints(part.column("text").to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(fp.view(np.int64))],
                    names=["doc_id", "key", "fp"])

    texts = docs.select("doc_id", row_key().alias("key"),
                        F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    prints = stage(texts.mapInArrow(run, f"doc_id {id_type}, key long, fp long"))
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    hung = components(links(distinct, limit, leaf_size))
    rooted = distinct.join(hung, distinct["fp"] == hung["a"], "left").select(
        "fp", "least", F.coalesce("b", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id", "root")
    return prints.join(by_print, "fp").select("doc_id", "key", "fp", "component_id", "root")
