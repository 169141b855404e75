"""Patient JSON records derived from ``customer`` (input of the validation job, V1–V4).

Each field is a JSON fragment chosen by ``c_custkey % m``; some residues give malformed or
missing values so every validation rule fires on part of the rows.  The same rule table
generates the Spark expression and the DuckDB oracle expression, so both engines validate
byte-identical JSON texts.

Placeholders in a fragment: {age} = c_custkey % 90, {g3} = male/female/other by key % 3,
{r6} = one of six valid races by key % 6, {race} = nation name, {eth} = region name,
{seg} = lower-cased market segment, {birth} = birth date 'yyyy-MM-dd'.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.sources import views as V

# Field -> (modulus, {residue: fragment or None (absent)}, default fragment).
FIELDS = [
    ("age", 13, {0: '"age": "invalid"', 1: '"age": 150', 2: '"age": "65"', 3: '"age": 65.7',
                 4: None, 5: '"age": null'}, '"age": {age}'),
    ("gender", 11, {0: '"gender": "INVALID"', 1: None, 2: '"gender": "Female"',
                    3: '"gender": 5'}, '"gender": "{g3}"'),
    ("race", 7, {5: None, 6: '"race": "{race}"'}, '"race": "{r6}"'),
    ("ethnicity", 5, {0: '"ethnicity": "Hispanic"', 1: '"ethnicity": "non-hispanic"', 2: None,
                      3: '"ethnicity": "unknown"'}, '"ethnicity": "{eth}"'),
    ("symptoms", 9, {0: '"symptoms": "headache"', 1: '"symptoms": []',
                     2: '"symptoms": ["  ", "cough"]',
                     3: '"symptoms": ["severe chest pain", "nausea"]',
                     4: '"symptoms": ["Chest Pain"]', 5: '"symptoms": [1, "fever"]', 6: None,
                     7: '"symptoms": ["Shortness of Breath", "Seizure"]'},
     '"symptoms": ["cough", "{seg}"]'),
    ("icd10", 6, {0: '"icd10": ["I21.4", "E11"]', 1: '"icd10": ["ABC", "123"]',
                  2: '"icd10": "I10"', 3: None, 4: '"icd10": ["J45.909"]'},
     '"icd10": ["I10", 7]'),
    ("dob", 8, {0: '"dob": "1980-13-45"', 1: None, 2: '"dob": "1980-2-5"',
                3: '"dob": "2021-02-30"'}, '"dob": "{birth}"'),
    ("medications", 4, {0: '"medications": [{"name": "aspirin", "dosage": "81mg"}]',
                        1: '"medications": [{"dosage": "10mg"}]', 2: '"medications": "aspirin"',
                        3: None}, None),
    ("medical_history", 5, {0: '"medical_history": [{"condition": "asthma", "diagnosed": "2001"}]',
                            1: '"medical_history": ["asthma"]',
                            2: '"medical_history": [{"diagnosed": "2001"}]',
                            3: '"medical_history": "asthma"'}, None),
]
GENDER3 = ["male", "female", "other"]
RACE6 = ["white", "black", "asian", "native_american", "pacific_islander", "other"]

_TOKEN = re.compile(r"\{(age|g3|r6|race|eth|seg|birth)\}")


def _spark_placeholder(name: str) -> Column:
    k = F.col("ID")
    return {
        "age": (k % 90).cast("string"),
        "g3": F.element_at(F.array(*[F.lit(x) for x in GENDER3]), (k % 3 + 1).cast("int")),
        "r6": F.element_at(F.array(*[F.lit(x) for x in RACE6]), (k % 6 + 1).cast("int")),
        "race": F.col("RACE"), "eth": F.col("ETHNICITY"), "seg": F.lower(F.col("GENDER")),
        "birth": F.col("BIRTHDATE").cast("string"),
    }[name]


def _sql_placeholder(name: str) -> str:
    return {
        "age": "CAST(ID % 90 AS VARCHAR)",
        "g3": "CASE ID % 3 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(GENDER3)) + " END",
        "r6": "CASE ID % 6 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(RACE6)) + " END",
        "race": "RACE", "eth": "ETHNICITY", "seg": "lower(GENDER)",
        "birth": "CAST(BIRTHDATE AS VARCHAR)",
    }[name]


def _pieces(template: str):
    pos = 0
    for m in _TOKEN.finditer(template):
        if m.start() > pos:
            yield ("lit", template[pos:m.start()])
        yield ("ph", m.group(1))
        pos = m.end()
    if pos < len(template):
        yield ("lit", template[pos:])


def _spark_fragment(t: str | None) -> Column:
    if t is None:
        return F.lit(None).cast("string")
    return F.concat(*[F.lit(v) if kind == "lit" else _spark_placeholder(v) for kind, v in _pieces(t)])


def _sql_fragment(t: str | None) -> str:
    if t is None:
        return "NULL"
    parts = []
    for kind, v in _pieces(t):
        parts.append("'" + v.replace("'", "''") + "'" if kind == "lit" else f"({_sql_placeholder(v)})")
    return " || ".join(parts)


def _spark_field(mod: int, cases: dict, default) -> Column:
    expr = _spark_fragment(default)
    for r, t in cases.items():
        expr = F.when(F.col("ID") % mod == r, _spark_fragment(t)).otherwise(expr)
    return expr


def record_text() -> Column:
    """JSON object text built from the fragments (absent fields skipped by concat_ws)."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *[_spark_field(m, c, d) for _, m, c, d in FIELDS]),
                    F.lit("}"))


def patient_records(spark: SparkSession, sf: str) -> DataFrame:
    """record_id, record (JSON text).  The rows are dealt out first: the table may be one small file,
    whose rows make texts that take much longer to check than to read."""
    from casebook.functions.columns import cached_expr
    dealt = V.patients(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    return dealt.select(F.col("ID").alias("record_id"),
                                        cached_expr("patient_record_text", record_text).alias("record"))


def record_sql() -> str:
    """DuckDB SELECT producing the same (record_id, record) over the ``patients`` view."""
    fields = []
    for _, mod, cases, default in FIELDS:
        whens = " ".join(f"WHEN {r} THEN {_sql_fragment(t)}" for r, t in cases.items())
        fields.append(f"CASE ID % {mod} {whens} ELSE {_sql_fragment(default)} END")
    return ("SELECT ID AS record_id, '{' || concat_ws(', ', " + ", ".join(fields) + ") || '}' AS record "
            "FROM patients")
