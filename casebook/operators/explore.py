"""Exploration reports.

Every report is an aggregate: only the (small) result leaves the cluster.  Whole-column
statistics (min/max for histogram edges) are scalar subqueries inlined into the binning
expression; box-plot statistics come from per-group value counts; nothing uses an
unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.columns import age_years_real, short_label, year_boundaries

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|Infinity)$"
DEFAULT_AS_OF = "2025-01-01"   # "today" of the age report, fixed so runs repeat


# ---------------------------------------------------------------- A1

def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows — one count per named table; absent (None) tables are skipped."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"),
                                                             "n_rows")
             for name, df in tables.items() if df is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- A2 / A23 / X2

def clean_demographics(patients: DataFrame, as_of: str = DEFAULT_AS_OF) -> DataFrame:
    """GENDER, age: rows with birth date and gender, birth castable, age >= 0."""
    birth = F.col("BIRTHDATE").cast("string").try_cast("date")
    return (patients.where(F.col("BIRTHDATE").isNotNull() & F.col("GENDER").isNotNull())
            .select("GENDER", birth.alias("birth"))
            .where(F.col("birth").isNotNull())
            .select("GENDER", age_years_real(F.lit(as_of).cast("date"), F.col("birth")).alias("age"))
            .where(F.col("age") >= 0))


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """key, n ordered by n desc then key (A2)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col(key).asc_nulls_last()))


def equal_width_histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """bin, bin_lo, bin_hi, n — numpy-style equal-width bins over [min, max].

    The last bin is closed on the right.  min = max gives one range of width 1 centred on
    the value (numpy's convention).  Empty bins are reported with n = 0.
    """
    vals = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    return binned_counts(vals, bins)


def histogram_range(vals: DataFrame):
    """(lo, hi) scalar subqueries over column x; min = max widens to ±0.5 like numpy."""
    st = vals.agg(F.min("x").alias("lo0"), F.max("x").alias("hi0"))
    lo = st.select(F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5)
                   .otherwise(F.col("lo0"))).scalar()
    hi = st.select(F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5)
                   .otherwise(F.col("hi0"))).scalar()
    return lo, hi


def binned_counts(vals: DataFrame, bins: int, group_cols: tuple[str, ...] = (),
                  group_values: list | None = None) -> DataFrame:
    """[group...,] bin, bin_lo, bin_hi, n over column x (numpy bin rule, empty bins = 0).

    The range comes from scalar subqueries; the bin grid (bins x known group values) is a
    tiny generated frame joined to the counts by broadcast.
    """
    lo, hi = histogram_range(vals)
    # numpy's form: (x - lo) * (bins / (hi - lo)), floored; x == hi goes to the last bin.
    idx = F.floor((F.col("x") - lo) * (F.lit(bins) / (hi - lo))).cast("int")
    counted = (vals.select(*group_cols, F.when(idx >= bins, bins - 1).otherwise(idx).alias("bin"))
               .groupBy(*group_cols, "bin").agg(F.count(F.lit(1)).alias("n")))
    spark = vals.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if group_cols:
        # bins x group values, generated (both are tiny, fixed lists)
        vals_arr = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(group_cols, row)])
                             for row in group_values])
        grid = grid.select("bin", F.explode(vals_arr).alias("_g")).select("bin", "_g.*")
    grid = grid.select(*group_cols, "bin",
                       (lo + (hi - lo) * F.col("bin") / bins).alias("bin_lo"),
                       (lo + (hi - lo) * (F.col("bin") + 1) / bins).alias("bin_hi"))
    return (grid.join(F.broadcast(counted), [*group_cols, "bin"], "left")
                .select(*group_cols, "bin", F.round("bin_lo", 6).alias("bin_lo"),
                        F.round("bin_hi", 6).alias("bin_hi"),
                        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


# ---------------------------------------------------------------- A3 / A4 / L1 / F11

def top_by_frequency(df: DataFrame, keys: list[str], n: int = 20, label_col: str | None = None,
                     counts: DataFrame | None = None) -> DataFrame:
    """keys..., n [, label] — the n most frequent non-null key combinations.

    Ties at the cut are broken by the keys (ascending) so the result is repeatable.
    ``counts`` may pass a pre-aggregated (keys..., n) frame instead of raw rows.
    """
    if counts is None:
        cond = None
        for k in keys:
            cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
        counts = df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), *[F.col(k).asc() for k in keys]).limit(n)
    if label_col:
        top = top.withColumn("label", short_label(label_col))
    return top


def frequency_through_dimension(fact: DataFrame, fk: str, dim: DataFrame, dim_key: str,
                                attr: str) -> DataFrame:
    """attr, n — row counts of ``fact`` grouped by a dimension attribute.

    The fact side is first counted per foreign key (map-side partial aggregation), so the
    join and the second aggregation see one row per key instead of one per fact row.
    Matches ``fact LEFT JOIN dim`` grouped by ``attr`` for a dimension with unique keys.
    """
    per_key = fact.groupBy(fk).agg(F.count(F.lit(1)).alias("c"))
    joined = per_key.join(dim.select(dim_key, attr), per_key[fk] == dim[dim_key], "left")
    return (joined.where(F.col(attr).isNotNull())
                  .groupBy(attr).agg(F.sum("c").cast("long").alias("n")))


# ---------------------------------------------------------------- A5 / A6

def describe(df: DataFrame, col: str) -> DataFrame:
    """n, mean, std, min, q25, q50, q75, max — pandas ``describe`` with exact quantiles.

    The quantiles come from ``quantiles.exact_quantiles`` (exact, bounded memory); the two
    one-row results are put side by side by a union and one aggregate.
    """
    from casebook.operators.quantiles import exact_quantiles
    x = F.col(col).cast("double")
    moments = [F.count(x).cast("long").alias("n"), F.avg(x).alias("mean"),
               F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    m = df.where(F.col(col).isNotNull()).agg(*moments)
    q = exact_quantiles(df, [], col, [0.25, 0.5, 0.75], ["q25", "q50", "q75"]).drop("n")
    both = m.unionByName(q, allowMissingColumns=True)
    s = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50",
                                                             "q75", "max")])


def count_per_key(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """key, n — rows per key; a null key forms its own group (A5)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def numeric_values(observations: DataFrame, description: str) -> DataFrame:
    """value — numeric VALUEs of one observation kind; others drop, NaN included.

    The pattern keeps out what only Spark reads as a number (``1d``, ``2f``)."""
    text = F.trim(F.col("VALUE").cast("string"))
    v = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return (observations.where((F.col("DESCRIPTION") == description) & F.col("VALUE").isNotNull())
            .select(v.alias("value")).where(F.col("value").isNotNull()))


# ---------------------------------------------------------------- J7 / J8 / X4 / A24

def age_at_encounter(encounters: DataFrame, patients: DataFrame, top_n: int = 10) -> DataFrame:
    """encounter_id, DESCRIPTION, age_at_encounter for the top-n encounter kinds.

    Age = year boundaries between birth and encounter (SQL ``DATE_DIFF('year', ...)``);
    only encounters on/after birth.  The top-n frame has at most ``top_n`` rows, so the
    semi-join broadcasts it.
    """
    top = top_by_frequency(encounters, ["DESCRIPTION"], top_n).select("DESCRIPTION")
    enc = (encounters.select(F.col("ID").alias("encounter_id"), "PATIENT", "DESCRIPTION",
                             F.col("DATE").cast("string").try_cast("date").alias("d"))
           .where(F.col("d").isNotNull())
           .join(F.broadcast(top), "DESCRIPTION", "left_semi"))
    pts = (patients.select(F.col("ID").alias("PATIENT"),
                           F.col("BIRTHDATE").cast("string").try_cast("date").alias("b"))
           .where(F.col("b").isNotNull()))
    age = year_boundaries(F.col("b"), F.col("d"))
    return (enc.join(pts, "PATIENT").where(F.col("d") >= F.col("b"))
               .select("encounter_id", "DESCRIPTION", age.alias("age_at_encounter"))
               .where(F.col("age_at_encounter") >= 0))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, q1, median, q3, whisker_lo, whisker_hi, n_outliers (A24, Tukey 1.5·IQR).

    Rows are first counted per (group, value) with map-side partial aggregation.  Exact
    quartiles come from a running count per group over those distinct values, the whiskers
    (furthest data points inside the fences, as in matplotlib) and the outlier count from one
    more aggregate.  The running count holds the distinct values of a group (ages: a few
    hundred); for continuous values take the quartiles from ``quantiles.exact_quantiles``.
    """
    from pyspark.sql import Window
    x = F.col(value).cast("double")
    counts = (df.where(x.isNotNull()).groupBy(group, x.alias("v"))
              .agg(F.count(F.lit(1)).alias("c")))
    own = Window.partitionBy(group)
    run = counts.select(group, "v", "c", F.sum("c").over(own.orderBy("v")).alias("cum"),
                        F.sum("c").over(own).alias("n"))

    def at(rank):        # value at a 0-based rank: the one whose running count first passes it
        return F.max(F.when((rank >= F.col("cum") - F.col("c")) & (rank < F.col("cum")), F.col("v"))).over(own)

    def quantile(q):
        pos = (F.col("n") - 1) * F.lit(q)
        lo, hi = F.floor(pos), F.ceil(pos)
        return F.when(hi == lo, at(lo)).otherwise((hi - pos) * at(lo) + (pos - lo) * at(hi))

    run = run.select("*", quantile(0.25).alias("q1"), quantile(0.5).alias("median"),
                     quantile(0.75).alias("q3"))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - fence) & (F.col("v") <= F.col("q3") + fence)
    out = run.groupBy(group).agg(
        F.max("n").cast("long").alias("n"), *[F.max(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("c"))).cast("long").alias("n_outliers"))
    return out.select(group, "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3",
                                                                     "whisker_lo", "whisker_hi")],
                      "n_outliers")


# ---------------------------------------------------------------- J9 / A25

def conditions_vs_encounters(conditions: DataFrame, encounters: DataFrame) -> DataFrame:
    """PATIENT, num_conditions, num_encounters — patients with both kinds (null never joins)."""
    c = count_per_key(conditions, "PATIENT", "num_conditions")
    e = count_per_key(encounters, "PATIENT", "num_encounters")
    return c.join(e, "PATIENT")


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n_patients — density of the scatter at scale."""
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n_patients"))

