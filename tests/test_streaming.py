"""Append-only record log (S19) as an exactly-once file stream."""
import json
import os

from casebook.sources.ingest import scratch_dir
from casebook.streaming.records import DIAGNOSIS_SCHEMA, start_record_log


def _drop(folder, name, records):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(json.dumps(r) for r in records) + "\n")


def test_record_log_appends_each_file_once(spark):
    base = scratch_dir(spark, "stream-test").replace("file:", "")
    landing, log, cp = f"{base}/landing", f"file:{base}/log", f"file:{base}/cp"
    _drop(landing, "a.json", [{"patient_id": "P1", "predicted_diagnosis": "X", "ground_truth": "X",
                               "confidence": 0.9, "site": "north"},
                              {"patient_id": "P2", "predicted_diagnosis": "X", "ground_truth": "",
                               "confidence": 0.4, "site": "south"}])
    q = start_record_log(spark, f"file:{landing}", log, DIAGNOSIS_SCHEMA, ["site"], cp)
    q.awaitTermination(120)
    _drop(landing, "b.json", [{"patient_id": "P3", "predicted_diagnosis": "Y", "ground_truth": "X",
                               "confidence": 0.1, "site": "north"}])
    q = start_record_log(spark, f"file:{landing}", log, DIAGNOSIS_SCHEMA, ["site"], cp)
    q.awaitTermination(120)
    out = {r.patient_id: (r.correct, r.extra["site"]) for r in spark.read.parquet(log).collect()}
    assert out == {"P1": (True, "north"), "P2": (None, "south"), "P3": (False, "north")}
