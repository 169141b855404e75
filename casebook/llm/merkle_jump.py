"""Merkle manifest of a table, with a proof for every row by pointer jumping (operator 11).

A row's leaf is the SHA-256 of its fields, each written as ``-`` (null) or its UTF-8 length,
``:`` and its value.  The leaves of a partition, in key order, form a tree in which every two
neighbours become the hash of their hex digests (a node left alone is hashed alone); the
subroots, in partition order, form the upper tree in the same way.

Trees are built in blocks of 2^``BLOCK_LEVELS`` neighbours, so the levels of a partition with
10^12 rows take four rounds and no task sees more than one block.  Every node then holds a
*segment*, the sibling it needs for its first step, and a pointer to its parent.  A round of
pointer jumping joins each node with the node it points to: the segments are concatenated
and the pointer becomes the other one's pointer, so the distance to the ancestor doubles
until every leaf points past the root.  After round k only inner nodes on levels divisible by
2^(k+1) are still pointed to, so the inner side shrinks by half each time (nodes of the upper
tree, below partitions of different heights, are all kept).

A segment entry is 33 bytes: ``L`` or ``R`` (where the sibling stands) or ``-`` (no sibling),
then the sibling's digest.

Nulls: a null partition is a partition of its own, before all others; null keys come first.
Rows with one key stand in the order of their leaves; repeated rows are leaves of their own
(which of them gets which place does not matter, they are equal).  Null and empty texts differ
(``-`` and ``0:``).  A very long text is hashed whole, in its own row, and travels no further.
An empty table gives no rows.  Columns that are no fields are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import reach_workers, stage
from casebook.operators.ordering import global_index

BLOCK_LEVELS = 10
#: Inner nodes (a few hundred bytes each) that a join may broadcast.
BROADCAST_NODES = 1 << 14
ENTRY = 33
TOP = -1                      # number of the upper tree; the others count from 0
NODE = "struct<tree:bigint,level:int,pos:bigint>"


def leaf_digest(fields: list[Column]) -> Column:
    """32-byte leaf of a row, from its fields in order."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts]), 256))


def _hex(digest) -> Column:
    return F.lower(F.hex(digest))


def _climber(block_levels: int):
    """All nodes over one block of neighbours, each with its first segment and its parent; the
    block's own top comes last, with neither."""

    def climb(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        tree, level, count = (int(block[c].iloc[0]) for c in ("tree", "level", "n"))
        lone = bool(block["lone"].iloc[0])
        digests = [bytes(d) for d in block["digest"]]
        first = int(block["pos"].iloc[0])
        out = []
        for _ in range(block_levels):
            if count == 1:
                break
            up = -(-count // 2)
            for i, own in enumerate(digests):
                other = i ^ 1
                seg = (b"-" + bytes(32) if other >= len(digests)
                       else (b"L" if i & 1 else b"R") + digests[other])
                if up > 1:
                    to = (tree, level + 1, (first + i) >> 1)
                else:             # the parent is a subroot (a node of the upper tree) or the root
                    to = None if tree == TOP or lone else (TOP, 0, tree)
                out.append((tree, level, first + i, count, own, seg, to))
            digests = [hashlib.sha256("".join(d.hex() for d in digests[i:i + 2]).encode()).digest()
                       for i in range(0, len(digests), 2)]
            first, level, count = first >> 1, level + 1, up
        out.append((tree, level, first, count, digests[0], None, None))
        frame = pd.DataFrame(out, columns=["tree", "level", "pos", "n", "digest", "seg", "to"], dtype=object)
        return frame.assign(lone=lone)

    return climb


def _grow(leaves: DataFrame, block_levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (staged parts) and tops of the trees over ``leaves`` (tree, level, pos, n, digest, lone)."""
    schema = f"tree long, level int, pos long, n long, digest binary, seg binary, to {NODE}, lone boolean"
    parts, tops, now = [], [], leaves
    while True:
        made = stage(now.groupBy("tree", F.shiftright("pos", block_levels).alias("block"))
                     .applyInPandas(_climber(block_levels), schema))
        parts.append(made.where("seg IS NOT NULL"))
        ends = made.where("seg IS NULL").drop("seg", "to")
        tops.append(ends.where("n = 1"))
        now = ends.where("n > 1")
        if now.isEmpty():
            break
    found = tops[0]
    for t in tops[1:]:
        found = found.union(t)
    return parts, found


def _follow(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    """One jump: ``nodes`` joined with the inner nodes that they point to."""
    there = inner.select(F.col("id").alias("there"), F.col("seg").alias("seg2"), F.col("to").alias("to2"))
    if there.count() <= BROADCAST_NODES:
        there = F.broadcast(there)
    return (nodes.join(there, F.col("to") == F.col("there"))
            .withColumn("seg", F.concat("seg", "seg2")).withColumn("to", F.col("to2"))
            .drop("there", "seg2", "to2"))


def proofs(rows: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``rows`` has ``part`` (sortable, nulls first), ``key`` (sortable), ``leaf`` (32 bytes) and
    ``carry`` (anything).  Returns carry, leaf, subroot, root (32 bytes each) and ``proof`` (the
    segment from the leaf to the root)."""
    spark = rows.sparkSession
    reach_workers(spark)
    # the salt tells equal rows apart, so a hot group of them spreads over the ranges
    rows = stage(rows.select("part", "key", "leaf", "carry",
                             F.monotonically_increasing_id().alias("salt")))
    sizes = stage(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    n_parts = sizes.count()
    if n_parts == 0:
        return rows.select("carry", "leaf", F.col("leaf").alias("subroot"), F.col("leaf").alias("root"),
                           F.col("leaf").alias("proof"))
    lone = F.lit(n_parts == 1)
    numbered = global_index(sizes.select("part"), "part", name="tree")
    placed = global_index(rows, "key", name="pos", tie_cols=("leaf", "salt"),
                          partition_cols=("part",), group_count="n")
    trees = numbered.select(F.col("part").alias("p"), "tree")
    leaves = stage(placed.join(trees, F.col("part").eqNullSafe(F.col("p")))
                   .select("tree", "pos", "n", "leaf", "carry"))
    parts, tops = _grow(leaves.where("n > 1").select("tree", F.lit(0).alias("level"), "pos", "n",
                                                     F.col("leaf").alias("digest"), lone.alias("lone")), block_levels)
    subroots = stage(tops.select("tree", "digest").union(
        leaves.where("n = 1").select("tree", F.col("leaf").alias("digest"))))
    upper, root = _grow(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"),
                                        F.col("tree").alias("pos"), F.lit(n_parts).cast("long").alias("n"),
                                        "digest", F.lit(False).alias("lone")), block_levels)
    root_digest = bytes(root.select("digest").first()[0])

    node = F.struct("tree", "level", "pos").alias("id")
    inner = [p.where("level > 0" if i == 0 else "true").select(node, "seg", "to") for i, p in enumerate(parts)]
    inner += [p.select(node, "seg", "to") for p in upper]
    table = inner[0]
    for p in inner[1:]:
        table = table.union(p)
    first = parts[0].where("level = 0").select("tree", "pos", "seg", "to")
    own = F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"))
    pending = leaves.where("n > 1").join(first, ["tree", "pos"]).select("tree", "leaf", "carry", "seg", "to")
    pending = pending.union(leaves.where("n = 1").select(
        "tree", "leaf", "carry", F.lit(b"").alias("seg"), F.when(~lone, own).cast(NODE).alias("to")))
    pending, table = stage(pending), stage(table)
    done, step = [], 1
    while True:
        done.append(pending.where("to IS NULL"))
        pending = pending.where("to IS NOT NULL")
        if pending.isEmpty():
            break
        pending = stage(_follow(pending, table))
        needed = F.expr(f"id.tree = {TOP} OR id.level % {2 * step} = 0")
        kept = table.where(needed)
        table = stage(kept.where("to IS NULL").union(
            _follow(kept.where("to IS NOT NULL"), table).select("id", "seg", "to")))
        step *= 2
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    if n_parts <= BROADCAST_NODES:
        subroots = F.broadcast(subroots)
    return every.join(subroots, "tree").select(
        "carry", "leaf", F.col("digest").alias("subroot"), F.lit(root_digest).alias("root"),
        F.col("seg").alias("proof"))


def entries(proof: Column) -> Column:
    """A proof as an array of 33-byte entries, leaf first."""
    n = (F.octet_length(proof) / ENTRY).cast("int")
    at = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    return F.transform(at, lambda i: F.substring(proof, i * ENTRY + 1, F.lit(ENTRY)))


def siblings_digest(proof: Column) -> Column:
    """Hex digest of the proof's siblings (hex digests, concatenated from the leaf up)."""
    there = F.filter(entries(proof), lambda e: F.substring(e, 1, 1) != F.lit(b"-"))
    return F.sha2(F.array_join(F.transform(there, lambda e: _hex(F.substring(e, 2, 32))), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """Hex root that a leaf's digest and its proof lead to."""
    def up(own, e):
        side, sibling = F.substring(e, 1, 1), _hex(F.substring(e, 2, 32))
        return F.sha2(F.when(side == F.lit(b"L"), F.concat(sibling, own))
                      .when(side == F.lit(b"R"), F.concat(own, sibling)).otherwise(own), 256)
    return F.aggregate(entries(proof), _hex(leaf), up)


def manifest(docs: DataFrame, tampered: Column, change: dict[str, Column],
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             part: str = "lang", key: str = "doc_id", block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether the row still folds to the root
    when ``change`` (field -> expression) is applied where ``tampered`` holds."""
    own = leaf_digest([F.col(f) for f in fields])
    bad = leaf_digest([change.get(f, F.col(f)) for f in fields])
    found = proofs(docs.select(
        F.col(part).alias("part"), F.col(key).alias("key"), own.alias("leaf"),
        F.struct(F.col(key).alias("key"), F.when(tampered, bad).alias("bad")).alias("carry")), block_levels)
    folded = fold(F.coalesce("carry.bad", "leaf"), F.col("proof"))
    return found.select(F.col("carry.key").alias(key), _hex("leaf").alias("leaf"),
                        _hex("subroot").alias("subroot"), _hex("root").alias("root"), "proof",
                        folded.alias("folded_root"))
