"""Evaluation slice.

One row per patient: the patient's last condition (latest STOP, an open condition — null
STOP — counting as latest), joined to the patient, with a text vignette and a coarse domain.
The last condition is a grouped ``max`` over an ordering struct: a hash/sort aggregate with
map-side partial aggregation, so a patient with very many conditions is still one small
group after the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.columns import age_by_year, capitalize
from casebook.operators.ordering import shuffle_key

REF_YEAR = 2025
SEED = 42
# Code prefix -> domain of the slice (first match wins, else General).
PREFIX_DOMAINS = (("I", "Cardiology"), ("E", "Metabolic"))
OTHER_DOMAIN = "General"


def last_condition(conditions: DataFrame) -> DataFrame:
    """PATIENT, START, STOP, CODE, DESCRIPTION of the latest condition per patient.

    Order: open (null STOP) first, then latest STOP; remaining ties by START, CODE,
    DESCRIPTION (largest wins).  Rows with a null PATIENT are dropped.
    """
    key = F.struct(F.col("STOP").isNull().alias("open"), F.col("STOP"), F.col("START"),
                   F.col("CODE"), F.col("DESCRIPTION"))
    best = (conditions.where(F.col("PATIENT").isNotNull())
            .groupBy("PATIENT").agg(F.max(key).alias("k")))
    return best.select("PATIENT", "k.START", "k.STOP", "k.CODE", "k.DESCRIPTION")


def domain_of(code) -> F.Column:
    """Case-sensitive code prefix -> domain."""
    c = F.col(code).cast("string") if isinstance(code, str) else code
    expr = F.lit(OTHER_DOMAIN)
    for prefix, dom in reversed(PREFIX_DOMAINS):
        expr = F.when(c.startswith(prefix), F.lit(dom)).otherwise(expr)
    return expr


def build_slice(patients: DataFrame, conditions: DataFrame) -> DataFrame:
    """patient_id, age, gender, icd10_code, icd10_text, vignette, domain."""
    last = last_condition(conditions)
    p = patients.select("ID", F.col("BIRTHDATE").cast("string").alias("BIRTHDATE"), "GENDER")
    m = p.join(last, p.ID == last.PATIENT, "inner")
    age = age_by_year(F.col("BIRTHDATE"), REF_YEAR)
    vignette = F.concat(F.lit("Patient "), capitalize(F.col("GENDER")), F.lit(", age "),
                        age.cast("string"),
                        F.lit(". Presenting with medical history culminating in diagnosis: "),
                        F.lower(F.col("DESCRIPTION")), F.lit("."))
    return m.select(F.col("ID").alias("patient_id"), age.cast("int").alias("age"),
                    F.col("GENDER").alias("gender"), F.col("CODE").cast("string").alias("icd10_code"),
                    F.col("DESCRIPTION").alias("icd10_text"), vignette.alias("vignette"),
                    domain_of("CODE").alias("domain"))


def stratified_sample(slice_df: DataFrame, n: int = 2000, seed: int = SEED,
                      key: str = "patient_id", stratum: str = "icd10_code") -> DataFrame:
    """At most max(1, n // 50) rows per code (hash order), then n rows overall.

    Applied only when the slice has more than n rows; with fewer capped rows than n, all
    capped rows are returned.  The per-code cap is a ``row_number`` filter that Spark turns
    into a partial limit before the shuffle; the final n is a bounded top-n.
    """
    from pyspark.sql import Window
    cap = max(1, n // 50)
    h = slice_df.withColumn("_h", shuffle_key(key, seed))
    w = Window.partitionBy(stratum).orderBy("_h", key)
    capped = h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    sampled = capped.orderBy("_h", key).limit(n).drop("_r", "_h")
    # Sample only when the slice is larger than n: decided inside the plan by a scalar
    # subquery over a count, not by a driver-side branch.
    big = slice_df.agg(F.count(F.lit(1)) > n).scalar()
    return sampled.where(big).unionByName(slice_df.where(~big))


def slice_meta(slice_df: DataFrame, seed: int = SEED) -> DataFrame:
    """n_rows, n_unique_codes, generation_seed."""
    return slice_df.agg(F.count(F.lit(1)).alias("n_rows"),
                        F.countDistinct("icd10_code").alias("n_unique_codes")).select(
        F.col("n_rows").cast("long"), F.col("n_unique_codes").cast("long"),
        F.lit(seed).cast("int").alias("generation_seed"))
