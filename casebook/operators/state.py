"""Aggregates kept as small mergeable states, one per load.

A state is a table; the states of two loads merge to the state of both together, whatever
the order, so a new load costs a pass over its own rows alone.

* ``day_counts``: rows per day.  Any discrete quantile of the dates (the flagship's cutoff)
  follows from it exactly.
* ``key_counts``: rows per key (conditions per patient); its summary, and the number of
  distinct keys, follow from it.
* ``value_sets``: the distinct values of several columns, as (column, value).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_counts(rows: DataFrame, date_col: str = "START") -> DataFrame:
    """day, n: rows per day; rows without a date are not counted."""
    return (rows.where(F.col(date_col).isNotNull()).groupBy(F.col(date_col).cast("date").alias("day"))
            .agg(F.count(F.lit(1)).alias("n")))


def key_counts(rows: DataFrame, key_col: str) -> DataFrame:
    """key, n: rows per non-null key."""
    return (rows.where(F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("key"))
            .agg(F.count(F.lit(1)).alias("n")))


def value_sets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value: each distinct non-null value, as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).where("value IS NOT NULL").distinct()


def merge(states: list[DataFrame]) -> DataFrame:
    """One state from several of a kind: counts add up, sets unite."""
    every = reduce(DataFrame.unionByName, states)
    keys = [c for c in every.columns if c != "n"]
    return every.groupBy(*keys).agg(F.sum("n").alias("n")) if "n" in every.columns else every.distinct()


def cutoff(days: DataFrame, q: float) -> DataFrame:
    """cutoff DATE: the discrete q-quantile of the dates (the first day up to which at least the
    share q of the rows lies), one row; null without rows.  The running sum has one row per
    day."""
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(F.lit(0))
    return (days.select("day", F.sum("n").over(upto).alias("upto"), F.sum("n").over(total).alias("total"))
            .where(F.col("upto") >= F.col("total") * F.lit(q)).agg(F.min("day").alias("cutoff")))


def counts_summary(keys: DataFrame) -> DataFrame:
    """n, mean, std, min, q25, q50, q75, max of the rows per key (A5), from the state alone."""
    from casebook.operators.explore import describe
    return describe(keys.withColumn("n", F.col("n").cast("double")), "n")


def distinct_counts(values: DataFrame) -> DataFrame:
    """column, n: distinct values per column."""
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def save(state: DataFrame, path: str, load: str) -> None:
    """Keep a load's state; saving a load again replaces it."""
    state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/load={load}")


def load_all(spark, path: str) -> DataFrame:
    """The merged state of all loads under ``path``."""
    return merge([spark.read.parquet(path).drop("load")])
