"""Exact global row indexes without a window over the rows.

The rows are range-partitioned by (group, order key) - boundaries are sampled from the data,
so sparse, dense and skewed keys give partitions of similar size - and sorted inside their
partition.  ``monotonically_increasing_id`` then carries (partition, position), and one
aggregate row per (group, partition) is enough to turn it into a position in the group.  The
sorted rows are written once to the shared scratch folder: the positions and the sizes must
come from the very same partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.plans.stage import materialise

POSITION_BITS = 33            # layout of monotonically_increasing_id: partition, position


def global_index(df: DataFrame, order_col: str, name: str = "idx",
                 tie_cols: tuple[str, ...] = (), partition_cols: tuple[str, ...] = (),
                 group_count: str | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_col`` (then ``tie_cols``) order,
    counted separately inside each ``partition_cols`` group (and ``group_count`` = the
    group's row count, when named).  Any sortable key type; nulls come first.

    The running sums below run over one row per (group, partition it touches).
    """
    parts = list(partition_cols)
    keys = [*parts, order_col, *tie_cols]
    rows = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                       .withColumn("_gi_m", F.monotonically_increasing_id()))
    rows = rows.withColumn("_gi_p", F.shiftright("_gi_m", POSITION_BITS))
    sizes = rows.groupBy(*parts, "_gi_p").agg(F.count(F.lit(1)).alias("_gi_c"), F.min("_gi_m").alias("_gi_first"))
    group = Window.partitionBy(*[F.col(c) for c in parts] or [F.lit(0)])
    before = group.orderBy("_gi_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(c).alias(f"_gi_{i}") for i, c in enumerate(parts)], F.col("_gi_p").alias("_gi_q"),
                           (F.coalesce(F.sum("_gi_c").over(before), F.lit(0)) - F.col("_gi_first")).alias("_gi_off"),
                           F.sum("_gi_c").over(group).alias("_gi_n"))
    same = F.col("_gi_p") == F.col("_gi_q")
    for i, c in enumerate(parts):
        same &= F.col(c).eqNullSafe(F.col(f"_gi_{i}"))
    out = rows.join(offsets, same).withColumn(name, (F.col("_gi_m") + F.col("_gi_off")).cast("long"))
    if group_count:
        out = out.withColumn(group_count, F.col("_gi_n").cast("long"))
    return out.drop("_gi_m", "_gi_p", "_gi_q", "_gi_off", "_gi_n", *[f"_gi_{i}" for i in range(len(parts))])


HASH_DIGITS = 15              # hex digits of the md5 that make the order key (60 bits)


def shuffle_key(key, seed: int = 42):
    """Repeatable pseudo-random order key in [0, 2^60) of a key of any type (its text form)."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(k.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("long")
