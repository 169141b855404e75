"""Record validation (V1–V4) — the reference's demo records."""
import json

from casebook.operators import validate as VAL

VALID = {"age": 65, "gender": "male", "race": "white", "ethnicity": "non-hispanic",
         "icd10": ["I25.10", "E11.9"], "symptoms": ["chest pain", "shortness of breath", "fatigue"],
         "medications": [{"name": "Lisinopril", "dosage": "10mg", "frequency": "daily"},
                         {"name": "Metformin", "dosage": "500mg", "frequency": "twice daily"}],
         "medical_history": [{"condition": "Type 2 Diabetes", "diagnosed": "2010-05-15"},
                             {"condition": "Hypertension", "diagnosed": "2012-03-22"}]}
INVALID = {"age": "invalid", "gender": "INVALID", "symptoms": "headache", "icd10": ["ABC", "123"]}
EMERGENCY = {"age": 72, "gender": "female",
             "symptoms": ["severe chest pain", "shortness of breath", "nausea"], "icd10": ["I21.0"]}


def _recs(spark, *records):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)],
                                 "record_id long, record string")


def test_validate_demo(spark):
    out = {r.record_id: r for r in VAL.validate(_recs(spark, VALID, INVALID)).collect()}
    assert out[0].is_valid and out[0].errors == []
    msgs = [e.message for e in out[1].errors]
    assert msgs == ["Age 'invalid' is not a valid number",
                    "Gender 'invalid' is not valid. Must be one of: male, female, other, unknown",
                    "Symptoms must be a list",
                    "Invalid ICD-10 code format in input field 'icd10': 'ABC'",
                    "Invalid ICD-10 code format in input field 'icd10': '123'"]


def test_validate_traps(spark):
    recs = [{"age": "65", "gender": "male", "symptoms": ["x"]},
            {"age": 65.7, "gender": "male", "symptoms": ["x"]},
            {"age": "65.7", "gender": "male", "symptoms": ["x"]},
            {"age": 121, "symptoms": [], "dob": "1980-2-30"},
            {"gender": "female", "symptoms": ["  ", 1], "medications": [{"dosage": "1"}, "x"]}]
    out = {r.record_id: [e.code for e in r.errors] for r in VAL.validate(_recs(spark, *recs)).collect()}
    assert out[0] == [] and out[1] == []
    assert out[2] == ["age_not_a_number"]
    assert out[3] == ["missing_gender", "age_out_of_range", "symptoms_empty", "dob_invalid"]
    assert out[4] == ["missing_age", "symptom_invalid", "symptom_invalid",
                      "medication_item_missing_name", "medication_item_not_dict"]


def test_sanitize_demo(spark):
    r = VAL.sanitize(_recs(spark, INVALID)).collect()[0]
    assert r.age is None and r.gender == "unknown" and r.symptoms == [] and r.icd10 == []
    v = VAL.sanitize(_recs(spark, VALID)).collect()[0]
    assert v.age == 65 and v.icd10 == ["I25.10", "E11.9"] and len(v.medications) == 2


def test_emergency_demo(spark):
    out = {r.record_id: (r.is_emergency, r.emergency_reason)
           for r in VAL.emergency(_recs(spark, EMERGENCY, VALID, INVALID)).collect()}
    assert out[0] == (True, "Emergency symptom detected: severe chest pain")
    assert out[1] == (True, "Emergency symptom detected: chest pain")   # list order wins
    assert out[2] == (False, None)


def test_quality_report(spark):
    rep = {r.metric: r.n for r in VAL.quality_report(VAL.validate(_recs(spark, VALID, INVALID))).collect()}
    assert rep["valid"] == 1 and rep["invalid"] == 1 and rep["icd10_invalid"] == 2


def test_report_checks_every_record_once(spark):
    """One pass over the dealt-out records gives verdicts and rules; both verdicts are always there."""
    recs = _recs(spark, VALID, INVALID, EMERGENCY)
    assert {r.metric: r.n for r in VAL.quality_report(VAL.validate(recs.limit(0))).collect()} == \
        {"valid": 0, "invalid": 0}
    plan = VAL.quality_report(VAL.validate(recs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_patient_records_are_dealt_to_all_cores(spark, tmp_path):
    from casebook.sources.patient_json import patient_records
    for name, row, schema in (("customer", (1, 2, "AUTO"), "c_custkey long, c_nationkey int, c_mktsegment string"),
                              ("nation", (2, "PERU", 3), "n_nationkey int, n_name string, n_regionkey int"),
                              ("region", (3, "ASIA"), "r_regionkey int, r_name string")):
        spark.createDataFrame([row], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = patient_records(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {spark.sparkContext.defaultParallelism}, true" in plan
