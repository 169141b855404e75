"""Batch job entry points.

    python -m casebook.plans.jobs <job> ...                       (local / PYSPARK_SUBMIT_ARGS)
    spark-submit --py-files casebook.zip casebook/plans/jobs.py <job> ...   (cluster)


Each job wires library operators over the clinical tables stored as Parquet directories
(``<tables>/patients``, ``<tables>/conditions``, ... as written by the ``ingest`` job) and
writes its results as Parquet / JSON under ``--out``.  Jobs never collect data to the driver.

    ingest     --exports DIR [DIR ...] --out DIR         CSV exports -> Parquet tables + load report
    explore    --tables DIR --out DIR                    exploration reports
    corpus     --tables DIR --out DIR [--novel] [--limit N]
                                                         prompt samples (JSON lines) and domain splits
    evalslice  --tables DIR --out DIR [--n N]            evaluation slice + metadata sidecar
    evaluate   --predictions PATH --out DIR [--latencies PATH] [--prefix P] [--limit N]
                                                         metrics over a predictions table
    validate   --records PATH --out DIR                  validation / sanitising / emergency flags
    baseline   --data PATH --out DIR [--text-col C --label-col C]
                                                         TF-IDF + logistic regression report
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.plans.stage import materialise


def _t(spark: SparkSession, tables: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{tables.rstrip('/')}/{name}")


def _write(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    (w.json(path) if fmt == "json" else w.parquet(path))


def job_ingest(spark, a) -> None:
    from casebook.sources import ingest
    _write(ingest.convert_exports(spark, a.exports, f"{a.out}/tables"), f"{a.out}/load_report", "json")


def job_explore(spark, a) -> None:
    from casebook.operators import explore as E
    pts, cond = _t(spark, a.tables, "patients"), _t(spark, a.tables, "conditions")
    enc = _t(spark, a.tables, "encounters")
    demo = E.clean_demographics(pts)
    def present(name):          # a table that was not exported is left out of the report
        try:
            return _t(spark, a.tables, name)
        except AnalysisException:
            return None

    reports = {
        "table_counts": E.table_counts({n: present(n) for n in (
            "patients", "conditions", "observations", "encounters", "medications", "procedures",
            "allergies", "immunizations")}),
        "gender_counts": E.value_counts(demo, "GENDER"),
        "age_histogram": E.equal_width_histogram(demo, "age", 30),
        "top_encounters": E.top_by_frequency(enc, ["DESCRIPTION"], 20, "DESCRIPTION"),
        "top_conditions": E.top_by_frequency(cond, ["DESCRIPTION", "CODE"], 20, "DESCRIPTION"),
        "conditions_per_patient_summary": E.describe(E.count_per_key(cond, "PATIENT"), "n"),
        "age_boxplot": E.box_stats(E.age_at_encounter(enc, pts, 10), "DESCRIPTION",
                                   "age_at_encounter"),
        "conditions_vs_encounters": E.conditions_vs_encounters(cond, enc),
    }
    for view, col in (("observations", "DESCRIPTION"), ("medications", "DESCRIPTION"),
                      ("procedures", "DESCRIPTION"), ("allergies", "DESCRIPTION"),
                      ("immunizations", "CODE")):
        if (df := present(view)) is not None:
            reports[f"top_{view}"] = E.top_by_frequency(df, [col], 20, col)
    for name, df in reports.items():
        _write(df, f"{a.out}/{name}")


def job_corpus(spark, a) -> None:
    from casebook.operators import corpus, splits
    cond, pts = _t(spark, a.tables, "conditions"), _t(spark, a.tables, "patients")
    s = corpus.corpus_samples(cond, pts, allow_repeats=not a.novel)
    s = materialise(corpus.limit_samples(s, a.limit))       # read by three outputs
    rejected = corpus.rejected_dates(cond, "START").unionByName(corpus.rejected_dates(pts, "BIRTHDATE"))
    _write(rejected, f"{a.out}/rejected_dates", "json")
    _write(s.select("text", "label"), f"{a.out}/samples", "json")
    if a.domain_map == "none":
        dmap = spark.createDataFrame([], "code string, domain string")
    else:
        dmap = spark.read.parquet(a.domain_map)
    ds = splits.domain_samples(s, dmap)
    split = splits.split_domains(ds)
    split.write.mode("overwrite").partitionBy("domain", "split").parquet(f"{a.out}/domains")
    _write(splits.domain_stats(ds), f"{a.out}/domain_stats", "json")


def job_evalslice(spark, a) -> None:
    from casebook.operators import evalslice as ES
    from casebook.sources import ingest
    sl = ES.build_slice(_t(spark, a.tables, "patients"), _t(spark, a.tables, "conditions"))
    sample = ES.stratified_sample(sl, a.n)
    ingest.write_with_meta(sample, ES.slice_meta(sample), a.out)


def job_evaluate(spark, a) -> None:
    from casebook.operators import metrics as M
    preds = spark.read.parquet(a.predictions)
    if a.prefix:
        preds = M.prefix_filter(preds, a.prefix, ("diagnosis_code", "label", "true_diagnosis"))
    rows = materialise(M.processed_rows(preds, limit=a.limit))    # read by every report
    _write(rows, f"{a.out}/predictions")
    _write(M.run_summary(preds), f"{a.out}/run_summary", "json")
    _write(M.overall_scores(rows), f"{a.out}/overall", "json")
    _write(M.class_report(rows), f"{a.out}/class_report", "json")
    _write(M.agent_usage(rows), f"{a.out}/agent_usage", "json")
    _write(M.agent_accuracy(rows), f"{a.out}/agent_accuracy", "json")
    _write(M.calibration_fixed(rows), f"{a.out}/calibration", "json")
    _write(M.calibration_adaptive(rows), f"{a.out}/calibration_adaptive", "json")
    _write(M.confidence_histogram(rows), f"{a.out}/confidence_hist", "json")
    if a.latencies:
        _write(M.latency_stats(spark.read.parquet(a.latencies)), f"{a.out}/latency", "json")


def job_validate(spark, a) -> None:
    from casebook.operators import validate as V
    recs = spark.read.parquet(a.records) if not a.records.endswith(".jsonl") else \
        spark.read.text(a.records).select(F.monotonically_increasing_id().alias("record_id"),
                                          F.col("value").alias("record"))
    checked = materialise(V.validate(recs))
    _write(checked, f"{a.out}/validated")
    _write(V.sanitize(recs), f"{a.out}/sanitized")
    _write(V.emergency(recs), f"{a.out}/emergency")
    _write(V.quality_report(checked), f"{a.out}/quality_report", "json")


def job_baseline(spark, a) -> None:
    from casebook.operators import tfidf
    from casebook.sources.ingest import require_columns
    data = require_columns(spark.read.parquet(a.data), [a.text_col, a.label_col])
    # the key is the row's content, so the split is the same for any file layout
    data = data.select(F.sha2(F.to_json(F.struct(a.text_col, a.label_col)), 256).alias("row_id"),
                       a.text_col, a.label_col)
    preds, n_features, n_train = tfidf.logit_baseline(data, a.text_col, a.label_col, key="row_id")
    _write(tfidf.baseline_report(preds, n_features, n_train), f"{a.out}/report", "json")
    _write(preds, f"{a.out}/predictions")


JOBS = {"ingest": job_ingest, "explore": job_explore, "corpus": job_corpus,
        "evalslice": job_evalslice, "evaluate": job_evaluate, "validate": job_validate,
        "baseline": job_baseline}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="casebook.plans.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    s = sub.add_parser("ingest"); s.add_argument("--exports", nargs="+", required=True)
    s.add_argument("--out", required=True)
    s = sub.add_parser("explore"); s.add_argument("--tables", required=True)
    s.add_argument("--out", required=True)
    s = sub.add_parser("corpus"); s.add_argument("--tables", required=True)
    s.add_argument("--out", required=True); s.add_argument("--novel", action="store_true")
    s.add_argument("--limit", type=int, default=None)
    s.add_argument("--domain-map", dest="domain_map", default="none",
                   help="Parquet (code, domain); 'none' puts every sample in 'general'")
    s = sub.add_parser("evalslice"); s.add_argument("--tables", required=True)
    s.add_argument("--out", required=True); s.add_argument("--n", type=int, default=2000)
    s = sub.add_parser("evaluate"); s.add_argument("--predictions", required=True)
    s.add_argument("--out", required=True); s.add_argument("--latencies", default=None)
    s.add_argument("--prefix", default=None); s.add_argument("--limit", type=int, default=None)
    s = sub.add_parser("validate"); s.add_argument("--records", required=True)
    s.add_argument("--out", required=True)
    s = sub.add_parser("baseline"); s.add_argument("--data", required=True)
    s.add_argument("--out", required=True); s.add_argument("--text-col", dest="text_col",
                                                           default="prompt")
    s.add_argument("--label-col", dest="label_col", default="gold_icd10")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if spark is None:
        from casebook.session import build_session
        spark = build_session(app_name=f"casebook-{a.job}")
    JOBS[a.job](spark, a)


if __name__ == "__main__":
    main(sys.argv[1:])
