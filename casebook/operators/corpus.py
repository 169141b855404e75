"""Flagship corpus query: temporal cutoff -> per-patient history -> first future event -> prompt.

Plan shape (checked with ``explain``):

* the cutoff is a scalar subquery over a global aggregate; ``percentile_disc`` /
  ``percentile_approx`` aggregate partially on the map side with a buffer bounded by the
  distinct dates, and the value is inlined into the filters (no join);
* the history keeps only the first ``max_items`` items per patient: a ``row_number`` filter,
  which Spark turns into a partial ``WindowGroupLimit`` *before* the shuffle, so no task ever
  holds more than ``max_items`` rows per patient per map partition, however hot a patient is;
* the first future event and the novelty test come from two hash aggregations
  ((PATIENT, CODE) then PATIENT), both with map-side partial aggregation — no window over the
  whole future, no anti-join over all past codes;
* history and future are both grouped by PATIENT, so their join reuses that partitioning;
* the (possibly joined) input is read by three branches; ``staged=True`` writes it once to the
  shared scratch folder (worth it when the input is a join over much data), else each branch
  reads it in parallel;
* without the text (counts, splits, samples of ids) the history branch is not built at all.

Dates may come as text: they are read with ``try_cast`` and rows whose START is no date are
left out (``rejected_dates`` counts them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.columns import age_at, falsy_default
from casebook.plans.stage import materialise

HISTORY_ITEMS = 40            # fragments kept in the prompt's history (fixed value)
CUTOFF_QUANTILE = 0.8         # temporal cutoff = 0.8 quantile of condition start dates
NO_HISTORY = "no previous diagnoses"


def as_date(col: str) -> Column:
    """The column as DATE; text that is no date becomes null."""
    return F.col(col).cast("string").try_cast("date").alias(col)


def typed_conditions(conditions: DataFrame) -> DataFrame:
    """PATIENT, START (DATE), CODE, DESCRIPTION of the rows with a readable START."""
    if conditions.schema["START"].dataType.typeName() == "date":
        typed = conditions.select("PATIENT", "START", "CODE", "DESCRIPTION")
    else:
        typed = conditions.select("PATIENT", as_date("START"), "CODE", "DESCRIPTION")
    return typed.where(F.col("START").isNotNull())


def rejected_dates(df: DataFrame, col: str) -> DataFrame:
    """column, n_rows, n_missing, n_rejected: values that are there but are no dates."""
    raw = F.col(col).cast("string")
    return df.agg(F.lit(col).alias("column"), F.count(F.lit(1)).alias("n_rows"),
                  F.count(F.when(F.col(col).isNull(), 1)).alias("n_missing"),
                  F.count(F.when(F.col(col).isNotNull() & raw.try_cast("date").isNull(), 1))
                  .alias("n_rejected"))


def one_per_patient(patients: DataFrame) -> DataFrame:
    """PATIENT, BIRTHDATE, GENDER, RACE, ETHNICITY: one row per patient id (J1), the smallest of
    its rows, so that a repeated patient does not multiply samples."""
    row = F.struct(as_date("BIRTHDATE"), "GENDER", "RACE", "ETHNICITY")
    return (patients.where(F.col("ID").isNotNull()).groupBy(F.col("ID").alias("PATIENT"))
            .agg(F.min(row).alias("_r")).select("PATIENT", "_r.*"))


def temporal_cutoff(conditions: DataFrame, q: float = CUTOFF_QUANTILE, exact: bool = True,
                    accuracy: int = 10000) -> DataFrame:
    """One-row frame ``cutoff DATE`` = q-quantile of START.

    ``exact`` uses the discrete percentile over day numbers (matches SQL ``quantile_disc``);
    otherwise ``percentile_approx`` (sketch, bounded memory for any number of distinct values).
    """
    start = F.col("START")
    if exact:
        agg = F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY unix_date(START))")
        return conditions.where(start.isNotNull()).agg(
            F.date_from_unix_date(agg.cast("int")).alias("cutoff"))
    return conditions.agg(F.percentile_approx(start, q, accuracy).alias("cutoff"))


def patient_histories(conditions: DataFrame, cutoff: Column,
                      max_items: int = HISTORY_ITEMS) -> DataFrame:
    """PATIENT, story (first ``max_items`` items, ', '-joined) for START < cutoff.

    Item = ``CODE (DESCRIPTION)`` in (START, CODE, DESCRIPTION) order; an item with a null
    part is null and skipped by the join, so null items are ranked after all others.
    Patients whose past rows all have null items keep a row with an empty string.
    """
    past = conditions.where(F.col("START") < cutoff)
    item = F.concat(F.col("CODE"), F.lit(" ("), F.col("DESCRIPTION"), F.lit(")"))
    past = past.select("PATIENT", "START", "CODE", "DESCRIPTION", item.alias("item"))
    w = Window.partitionBy("PATIENT").orderBy(F.col("item").isNull(), "START", "CODE",
                                              "DESCRIPTION")
    top = past.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_items)
    ordered = F.array_sort(F.collect_list(F.struct("rn", "item")))
    return top.groupBy("PATIENT").agg(
        F.array_join(F.transform(ordered, lambda x: x["item"]), ", ").alias("story"))


def first_future(conditions: DataFrame, cutoff: Column) -> DataFrame:
    """PATIENT, cutoff, target, repeat, has_past — the first condition on/after the cutoff.

    Ties on START are broken by CODE (nulls first).  ``repeat`` is true when the same
    code already occurred before the cutoff (null codes never match); ``has_past`` when any
    condition did.
    """
    is_past = F.col("START") < cutoff
    # The last level is grouped by PATIENT alone, so the join with the history reuses the
    # same hash partitioning.
    per_code = conditions.where(F.col("START").isNotNull()).groupBy("PATIENT", "CODE").agg(
        F.max(is_past).alias("has_past"),
        F.min(F.when(~is_past, F.col("START"))).alias("first_start"))
    ahead = F.when(F.col("first_start").isNotNull(), F.struct("first_start", "CODE", "has_past"))
    best = (per_code.groupBy("PATIENT")
            .agg(F.min(ahead).alias("f"), F.max("has_past").alias("has_past"))
            .where(F.col("f").isNotNull()))
    return best.select("PATIENT", cutoff.alias("cutoff"), F.col("f.CODE").alias("target"),
                       (F.col("f.has_past") & F.col("f.CODE").isNotNull()).alias("repeat"), "has_past")


def history_prompt(past_details, cutoff, birth, gender, race, ethnicity,
                   max_items: int = HISTORY_ITEMS):
    """Prompt sentence (X1, X8–X10). History is split on ', ' and rejoined with '; '."""
    hist = F.when(F.coalesce(past_details, F.lit("")) == "", F.lit(NO_HISTORY)).otherwise(
        F.array_join(F.slice(F.split(past_details, ", ", -1), 1, max_items), "; "))
    age = F.coalesce(age_at(cutoff, birth).cast("string"), F.lit("unknown-age"))
    return F.concat(age, F.lit("-year-old "), falsy_default(gender, "unknown-gender"), F.lit(" "),
                    F.lower(falsy_default(race, "unknown-race")), F.lit(" "),
                    F.lower(falsy_default(ethnicity, "unknown-ethnicity")),
                    F.lit(" patient. History of: "), hist, F.lit("."))


def corpus_samples(conditions: DataFrame, patients: DataFrame, allow_repeats: bool = True,
                   exact_cutoff: bool = True, max_items: int = HISTORY_ITEMS,
                   staged: bool = False, cutoff: Column | None = None) -> DataFrame:
    """patient_id, text, label — one sample per patient with a past and a future.

    ``conditions`` feeds three branches (cutoff, history, future); it is projected to the
    four columns used and, with ``staged``, computed once.  ``cutoff`` (a date, as from
    ``state.cutoff(...).scalar()``) saves the pass for it; a table from ``timeline.lay_out``
    saves the exchanges by patient.
    """
    conditions = typed_conditions(conditions)
    if staged:
        conditions = materialise(conditions)
    if cutoff is None:
        cutoff = temporal_cutoff(conditions, exact=exact_cutoff).scalar()
    hist = patient_histories(conditions, cutoff, max_items)
    fut = first_future(conditions, cutoff)
    if not allow_repeats:
        fut = fut.where(~F.col("repeat"))
    joined = hist.join(fut, "PATIENT").join(one_per_patient(patients), "PATIENT")
    label = F.col("target").cast("string")
    prompt = history_prompt(F.col("story"), F.col("cutoff"), F.col("BIRTHDATE"),
                            F.col("GENDER"), F.col("RACE"), F.col("ETHNICITY"), max_items)
    return joined.select(F.col("PATIENT").alias("patient_id"),
                         F.concat(prompt, F.lit("\n\nAI: "), label).alias("text"),
                         label.alias("label"))


def corpus_labels(conditions: DataFrame, patients: DataFrame, allow_repeats: bool = True,
                  exact_cutoff: bool = True) -> DataFrame:
    """patient_id, label of the same samples as ``corpus_samples``, without building the text:
    one aggregation over the conditions, no history window."""
    conditions = typed_conditions(conditions)
    cutoff = temporal_cutoff(conditions, exact=exact_cutoff).scalar()
    fut = first_future(conditions, cutoff).where("has_past")
    if not allow_repeats:
        fut = fut.where(~F.col("repeat"))
    known = patients.select(F.col("ID").alias("PATIENT"))
    return fut.join(known, "PATIENT", "left_semi").select(
        F.col("PATIENT").alias("patient_id"), F.col("target").cast("string").alias("label"))


def limit_samples(samples: DataFrame, n: int | None) -> DataFrame:
    """L2: first n samples by patient id; n None or <= 0 keeps everything."""
    if n is None or n <= 0:
        return samples
    return samples.orderBy("patient_id").limit(n)


def count_samples(samples: DataFrame) -> DataFrame:
    """A10: row count before any limit, as a one-row frame."""
    return samples.agg(F.count(F.lit(1)).alias("n_rows"))
