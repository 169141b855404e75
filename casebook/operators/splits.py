"""Corpus domains and splits.

Splits are exact and repeatable: rows are ordered by a deterministic hash of their key (of any
type) and the first ``int(n * (1 - test_size))`` rows of a group go to train.  Positions come
from ``ordering.global_index`` (sampled ranges of the hash order, one row per range for the
offsets), so even the ``general`` domain, which holds every sample, is never ranked in a
single task.  ``general`` is split whatever its size; another domain only with more than
``MIN_DOMAIN_ROWS`` samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.columns import split_prompt_expected
from casebook.operators.ordering import global_index, shuffle_key

GENERAL = "general"
MIN_DOMAIN_ROWS = 10      # a domain other than general is split only with more than 10 samples


def _unique_codes(domain_map: DataFrame, name: str) -> DataFrame:
    """One domain per code, so that no sample is multiplied: of several the last in text order."""
    return (domain_map.where(F.col("code").isNotNull()).groupBy(F.col("code").cast("string").alias("_code"))
            .agg(F.max("domain").alias(name)))


def lookup_domain(df: DataFrame, code_col: str, domain_map: DataFrame) -> DataFrame:
    """Adds ``domain``: code -> domain from the map (code compared as string), else 'general'.

    ``domain_map`` has columns (code, domain); a code listed twice counts once (the last domain
    in text order).  It is joined, not collected: Catalyst / AQE
    broadcast it only when it is measured small enough.
    """
    m = _unique_codes(domain_map, "domain")
    j = df.join(m, F.col(code_col).cast("string") == F.col("_code"), "left")
    return j.withColumn("domain", F.coalesce(F.col("domain"), F.lit(GENERAL))).drop("_code")


def domain_samples(samples: DataFrame, domain_map: DataFrame, label_col: str = "label") -> DataFrame:
    """Samples per domain: every sample in 'general', plus its own domain when mapped.

    One pass: the domain lookup is a join, then each sample is emitted once or twice by
    ``explode``.  A null label never matches a domain (it stays in 'general' only).
    """
    m = _unique_codes(domain_map, "_dom")
    j = samples.join(m, F.col(label_col).cast("string") == F.col("_code"), "left")
    own = F.when(F.col("_dom").isNotNull() & (F.col("_dom") != GENERAL), F.col("_dom"))
    doms = F.array_compact(F.array(F.lit(GENERAL), own))
    return j.withColumn("domain", F.explode(doms)).drop("_code", "_dom")


def split_by_hash(df: DataFrame, key: str, group_cols: tuple[str, ...] = (),
                  test_size: float = 0.2, seed: int = 42,
                  min_rows: int | None = None, always: Column | None = None) -> DataFrame:
    """Adds ``split`` (train/test): per group, first int(n*(1-test_size)) rows in hash order.

    Groups with ``min_rows`` or fewer rows are left out (they are reported, not split), except
    those for which ``always`` holds.
    """
    h = df.withColumn("_h", shuffle_key(key, seed))
    ranked = global_index(h, "_h", "_pos", tie_cols=(key,), partition_cols=tuple(group_cols),
                          group_count="_n")
    if min_rows is not None:
        enough = F.col("_n") > min_rows
        ranked = ranked.where(enough if always is None else enough | always)
    train = (F.col("_n") * F.lit(1.0 - test_size)).cast("long")
    return (ranked.withColumn("split", F.when(F.col("_pos") < train, "train").otherwise("test"))
                  .drop("_h", "_n", "_pos"))


def split_domains(domains: DataFrame, key: str = "patient_id", test_size: float = 0.2,
                  seed: int = 42) -> DataFrame:
    """The corpus split: ``general`` always, other domains with more than 10 samples."""
    return split_by_hash(domains, key, ("domain",), test_size, seed, MIN_DOMAIN_ROWS,
                         F.col("domain") == GENERAL)


def domain_stats(domains: DataFrame, test_size: float = 0.2) -> DataFrame:
    """domain, total, train, test — domains that are not split report 0 / 0."""
    c = domains.groupBy("domain").agg(F.count(F.lit(1)).alias("total"))
    is_split = (F.col("domain") == GENERAL) | (F.col("total") > MIN_DOMAIN_ROWS)
    train = F.when(is_split, (F.col("total") * F.lit(1.0 - test_size)).cast("long")).otherwise(F.lit(0))
    test = F.when(is_split, F.col("total") - train).otherwise(F.lit(0))
    return c.select("domain", F.col("total").cast("long").alias("total"),
                    train.cast("long").alias("train"), test.cast("long").alias("test"))


def stratified_split(df: DataFrame, key: str, label_col: str, test_size: float = 0.25,
                     seed: int = 42) -> DataFrame:
    """Adds ``split`` stratified by label; unstratified when some class has a single row."""
    smallest = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.min("_c")).scalar()
    strata = df.withColumn("_stratum", F.when(smallest >= 2, F.col(label_col).cast("string"))
                           .otherwise(F.lit("*")))
    return split_by_hash(strata, key, ("_stratum",), test_size, seed).drop("_stratum")


def sample_examples(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k pseudo-random rows (hash order) — a top-k, the sampling feature itself."""
    return (df.withColumn("_h", shuffle_key(key, seed)).orderBy("_h", key).limit(k)
              .drop("_h"))


def with_prompt_expected(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds prompt / expected split at '\\nAI:' (X16)."""
    prompt, expected = split_prompt_expected(F.col(text_col))
    return df.withColumn("prompt", prompt).withColumn("expected", expected)


def read_domain_split(path_df: DataFrame, domain: str, split: str) -> DataFrame:
    """Read one domain/split of a partitioned corpus with fallback: own -> general -> all.

    ``path_df`` is the partitioned dataset (``partitionBy('domain', 'split')``); the filters
    prune partitions.  The fallback is decided from partition existence, not from row data.
    """
    own = path_df.where((F.col("domain") == domain) & (F.col("split") == split))
    if own.limit(1).count() > 0:
        return own
    gen = path_df.where((F.col("domain") == GENERAL) & (F.col("split") == split))
    if gen.limit(1).count() > 0:
        return gen
    return path_df
