"""Exact quantiles by radix selection: no sort of the rows, no range shuffle, no written table.

A double's bits, read as a signed integer with the sign folded in, grow with the value.  A pass
counts rows per (group, next 16 bits) among the rows that still share the prefix of a wanted
rank - at most 65 536 counts per group, combined map-side, so a hot group or a value that
fills half the table is a few rows per task - and a running sum over these counts tells
which digit the rank falls into.  A rank is settled as soon as all values of its bucket are
equal, after four passes at the latest.  The overall quantiles come from the same first counts,
summed over the groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.plans.stage import stage

DIGIT_BITS = 16
PASSES = 64 // DIGIT_BITS
_MASK = (1 << DIGIT_BITS) - 1


def with_order_key(df: DataFrame, x: str, name: str = "key") -> DataFrame:
    """Adds a 64-bit integer that grows with the double ``x`` (its IEEE bits, negated below zero);
    both zeros are 0, NaN is above infinity.  Exact: only powers of two are divided out."""
    two = F.lit(2.0)
    out = df.withColumn("_a", F.abs(x)).withColumn("_e", F.least(F.lit(1023.0), F.floor(F.log2("_a"))))
    # the logarithm may be one off beside a power of two
    out = out.withColumn("_e", F.col("_e") - F.when(F.pow(two, "_e") > F.col("_a"), 1).otherwise(0) + F.when(
        (F.col("_e") < 1023) & (F.pow(two, F.col("_e") + 1) <= F.col("_a")), 1).otherwise(0))
    normal = ((F.col("_e") + 1023).cast("long") * F.lit(1 << 52)
              + ((F.col("_a") / F.pow(two, "_e") - 1.0) * F.lit(float(1 << 52))).cast("long"))
    tiny = (F.col("_a") * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")        # below 2^-1022
    bits = (F.when(F.isnan("_a"), F.lit((2047 << 52) + 1)).when(F.col("_a") == 0, F.lit(0))
            .when(F.col("_a") < F.lit(2.0 ** -1022), tiny).when(F.col("_a") == F.lit(float("inf")), F.lit(2047 << 52))
            .otherwise(normal))
    return out.withColumn(name, F.when(F.col(x) < 0, F.lit(-1)).otherwise(F.lit(1)) * bits).drop("_a", "_e")


def _same(columns: list[str], suffix: str) -> Column:
    return reduce(lambda on, c: on & F.col(c).eqNullSafe(F.col(c + suffix)), columns, F.lit(True))


def _narrow(hist: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted ranks (``keys``, i, n, r) located in the counts (``keys``, digit, c, lo, hi): the
    bucket's digit and values, and the rank inside the bucket."""
    upto = Window.partitionBy(*keys, F.lit(0)).orderBy("digit")              # at most 65 536 rows
    summed = hist.withColumn("cum", F.sum("c").over(upto))
    asked = wanted.select(*[F.col(k).alias(f"{k}w") for k in keys], "i", "n", "r")
    return (summed.join(asked, _same(keys, "w")).where("r >= cum - c AND r < cum")
            .select(*keys, "i", "n", (F.col("r") - F.col("cum") + F.col("c")).alias("r"), "digit", "lo", "hi"))


def _select(vals: DataFrame, groups: list[str], first: DataFrame, qs: list[float]) -> DataFrame:
    """``groups``, i, n, x: the values at the ranks floor and ceil of q (n - 1), numbered 2k and
    2k + 1.  ``vals`` has groups, x and key; ``first`` the counts of its first digits."""
    n = first.groupBy(*groups).agg(F.sum("c").alias("n"))
    pos = [(F.col("n") - 1) * F.lit(q) for q in qs]
    ranks = F.array(*[F.struct(F.lit(2 * i + k).alias("i"), f(p).cast("long").alias("r"))
                      for i, p in enumerate(pos) for k, f in ((0, F.floor), (1, F.ceil))])
    wanted = n.select(*groups, "n", F.inline(ranks))
    found, held = [], []
    hist, keys = first, groups
    for step in range(PASSES):
        at = stage(_narrow(hist, wanted, keys))
        held.append(at)
        shift = 64 - DIGIT_BITS * (step + 1)
        prefix = F.col("digit") if step == 0 else F.col("prefix") * F.lit(1 << DIGIT_BITS) + F.col("digit")
        found.append(at.where("lo = hi").select(*groups, "i", "n", F.col("lo").alias("x")))
        wanted = at.where("lo < hi").select(*groups, prefix.alias("prefix"), "i", "n", "r")
        if shift == 0 or wanted.isEmpty():
            break
        keys = [*groups, "prefix"]
        open_ = wanted.select(*[F.col(k).alias(f"{k}w") for k in keys]).distinct()
        rest = vals.withColumn("prefix", F.shiftright("key", shift)).join(open_, _same(keys, "w"), "left_semi")
        hist = _counts(rest, keys, F.shiftright("key", shift - DIGIT_BITS).bitwiseAND(F.lit(_MASK)))
    return reduce(DataFrame.union, found)


def _counts(vals: DataFrame, keys: list[str], digit: Column) -> DataFrame:
    return vals.groupBy(*keys, digit.alias("digit")).agg(
        F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, qs: list[float],
                    names: list[str], total: bool = False) -> DataFrame:
    """group_cols..., n, <names...>: quantiles of ``value_col`` per group, interpolated between
    the ranks floor / ceil of q·(n-1) as ``percentile`` does (an empty ``group_cols`` gives one
    row over all rows).  Null values are ignored; a group without values has no row.
    ``total`` adds a row over all groups, with ``is_total`` true (and false in the others)."""
    g = [f"_g{i}" for i in range(len(group_cols))]
    x = F.col(value_col).cast("double")
    # all rows together are a group with a number of its own, so that every join has a key
    vals = df.select(*[F.col(c).alias(a) for a, c in zip(g, group_cols)], F.lit(0).alias("_all"),
                     x.alias("x")).where("x IS NOT NULL")
    vals = with_order_key(vals, "x")
    own = g or ["_all"]
    first = stage(_counts(vals, own, F.shiftright("key", 64 - DIGIT_BITS)))
    parts = [_select(vals, own, first, qs).select(*g, "i", "n", "x", F.lit(False).alias("is_total"))]
    if total and g:
        every = stage(first.groupBy(F.lit(0).alias("_all"), "digit").agg(
            F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        none = [F.lit(None).cast(vals.schema[c].dataType).alias(c) for c in g]
        parts.append(_select(vals, ["_all"], every, qs).select(*none, "i", "n", "x", F.lit(True).alias("is_total")))
    at = reduce(DataFrame.union, parts).groupBy("is_total", *g, "n").agg(
        *[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"_v{i}") for i in range(2 * len(qs))])
    out = []
    for i, (q, nm) in enumerate(zip(qs, names)):
        p = (F.col("n") - 1) * F.lit(q)
        lo, hi, a, b = F.floor(p), F.ceil(p), F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        out.append(F.when(hi == lo, a).otherwise((hi - p) * a + (p - lo) * b).alias(nm))
    return at.select(*(["is_total"] if total else []), *[F.col(a).alias(c) for a, c in zip(g, group_cols)], "n", *out)
