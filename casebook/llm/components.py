"""Connected components of an edge table by alternating star contraction.

Every round rewrites the edges twice: a large star hangs each node's greater neighbours on
the least node of its neighbourhood, a small star hangs a node and its smaller neighbours on
the least of them.  Both are one aggregate and one equi-join; nothing is collected, and each
round is written to the shared checkpoint folder, so lineage stays short and a lost executor
costs one round at most.  The edges end as stars around each component's least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import stage


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that is not the least of its component, with that least node.
    ``edges`` has two columns of one type; loops and repeated edges don't matter."""
    a, b = edges.columns
    now = stage(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    before = _digest(now)
    while before[0]:
        now = stage(_small_star(_large_star(now)))
        after = _digest(now)
        if after == before:
            break
        before = after
    return now
