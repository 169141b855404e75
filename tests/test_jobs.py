"""Batch job entry points, run end to end on tables written from the adapter views."""
import json
import os

import pytest

from casebook.plans import jobs
from casebook.sources import ingest as I
from casebook.sources import views as V
from casebook.sources.patient_json import patient_records

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    root = I.scratch_dir(spark, "job-tables")
    for name, df in {"patients": V.patients(spark, SF), "conditions": V.conditions(spark, SF),
                     "encounters": V.encounters(spark, SF),
                     "observations": V.observations(spark, SF),
                     "medications": V.line_views(spark, SF, "medications"),
                     "procedures": V.line_views(spark, SF, "procedures"),
                     "allergies": V.line_views(spark, SF, "allergies"),
                     "immunizations": V.immunizations(spark, SF)}.items():
        df.write.parquet(f"{root}/{name}")
    V.domain_map(spark, SF).write.parquet(f"{root}/domain_map")
    V.predictions(spark, SF).write.parquet(f"{root}/predictions")
    V.latencies(spark, SF).write.parquet(f"{root}/latencies")
    patient_records(spark, SF).write.parquet(f"{root}/records")
    return root


def test_corpus_and_explore_jobs(spark, tables):
    out = I.scratch_dir(spark, "job-out")
    jobs.main(["corpus", "--tables", tables, "--out", out, "--domain-map", f"{tables}/domain_map"],
              spark)
    assert spark.read.json(f"{out}/samples").count() == 134
    stats = {r.domain: r.total for r in spark.read.json(f"{out}/domain_stats").collect()}
    assert stats["general"] == 134
    jobs.main(["explore", "--tables", tables, "--out", out], spark)
    assert spark.read.parquet(f"{out}/table_counts").count() == 8


def test_evaluate_validate_evalslice_jobs(spark, tables):
    out = I.scratch_dir(spark, "job-out")
    jobs.main(["evaluate", "--predictions", f"{tables}/predictions", "--latencies",
               f"{tables}/latencies", "--out", out], spark)
    assert spark.read.json(f"{out}/class_report").where("label = 'macro avg'").count() == 1
    jobs.main(["validate", "--records", f"{tables}/records", "--out", out], spark)
    rep = {r.metric: r.n for r in spark.read.json(f"{out}/quality_report").collect()}
    assert rep["valid"] + rep["invalid"] == 150
    jobs.main(["evalslice", "--tables", tables, "--out", f"{out}/slice", "--n", "50"], spark)
    meta = spark.read.json(f"{out}/slice/meta").collect()[0]
    assert meta.n_rows == 50 and meta.generation_seed == 42


def test_ingest_job(spark):
    root = I.scratch_dir(spark, "job-csv").replace("file:", "")
    os.makedirs(f"{root}/a/csv")
    with open(f"{root}/a/csv/immunizations.csv", "w") as f:
        f.write("DATE,PATIENT,CODE\n2001-01-01,p1,140\n2002-01-01,p2,140\n")
    out = I.scratch_dir(spark, "job-ingest")
    jobs.main(["ingest", "--exports", f"file:{root}", "--out", out], spark)
    rep = {r.table: r.rows for r in spark.read.json(f"{out}/load_report").collect()}
    assert rep["immunizations"] == 2 and spark.read.parquet(f"{out}/tables/immunizations").count() == 2


def test_baseline_job(spark):
    data = I.scratch_dir(spark, "job-baseline-data")
    V.labelled_docs(spark, SF).selectExpr("text AS prompt", "label AS gold_icd10").write.parquet(data)
    out = I.scratch_dir(spark, "job-baseline")
    jobs.main(["baseline", "--data", data, "--out", out], spark)
    rep = {r.metric: r.value for r in spark.read.json(f"{out}/report").collect()}
    n_test = spark.read.parquet(f"{out}/predictions").count()
    assert rep["n_train"] + rep["n_test"] == 87 and rep["n_test"] == n_test
    assert 0.0 <= rep["accuracy"] <= 1.0


def test_chain_on_export_shaped_data(spark):
    """ingest -> corpus -> evalslice with text ids, one bad date, a repeated patient."""
    root = I.scratch_dir(spark, "job-chain").replace("file:", "")
    ids = [f"9bde2b07-b972-4954-8d68-{i:012d}" for i in range(20)]
    os.makedirs(f"{root}/in/one two/csv")
    with open(f"{root}/in/one two/csv/patients.csv", "w") as f:
        f.write("Id,BIRTHDATE,DEATHDATE,MARITAL,RACE,ETHNICITY,GENDER\n")
        f.writelines(f"{p},{'not a day' if i == 3 else '1970-02-03'},,M,white,irish,F\n"
                     for i, p in enumerate(ids))
    with open(f"{root}/in/one two/csv/conditions.csv", "w") as f:
        f.write("START,STOP,PATIENT,CODE,DESCRIPTION\n")
        for i, p in enumerate(ids):
            f.writelines(f"{1990 + k}-01-{1 + i:02d},,{p},{100 + k},\"cold, kind {k}\"\n" for k in range(4))
            f.write(f"2015-05-05,,{p},{200 + i % 2},later\n")
        f.write(f"whenever,,{ids[0]},1,x\n")
    jobs.main(["ingest", "--exports", f"file:{root}/in", "--out", f"file:{root}/out"], spark)
    tables = f"file:{root}/out/tables"
    jobs.main(["corpus", "--tables", tables, "--out", f"file:{root}/corpus"], spark)
    samples = spark.read.json(f"file:{root}/corpus/samples").collect()
    # one patient's last early condition falls on the cutoff day itself
    assert len(samples) == 20 and {r.label for r in samples} == {"103", "200", "201"}
    assert sum(r.text.startswith("unknown-age") for r in samples) == 1
    split = spark.read.parquet(f"file:{root}/corpus/domains").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 16, "test": 4}
    report = {r.table: r.rejected_dates for r in spark.read.json(f"file:{root}/out/load_report").collect()}
    assert report["conditions"] == 1 and report["patients"] == 1
    jobs.main(["evalslice", "--tables", tables, "--out", f"file:{root}/slice", "--n", "5"], spark)
    assert spark.read.parquet(f"file:{root}/slice/data").count() <= 5
