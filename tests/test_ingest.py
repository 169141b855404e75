"""File ingest (S1–S19) on small files written to a fresh scratch folder."""
import os

import pytest
from pyspark.sql import functions as F

from casebook.sources import ingest as I


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture()
def root(spark):
    d = I.scratch_dir(spark, "test")
    return d.replace("file:", "")


def test_tolerant_csv_drops_long_lines_and_fills_short(spark, root):
    _write(f"{root}/a.csv", "Id,X,Y\n1,a,b\n2,a,b,EXTRA\n3,a\n")
    df = I.read_csv_tolerant(spark, [f"{root}/a.csv"], ["Id", "X", "Y"])
    assert sorted(tuple(r) for r in df.collect()) == [("1", "a", "b"), ("3", "a", None)]


def test_merge_unions_headers_skips_empty_and_dedups_first(spark, root):
    _write(f"{root}/a1/csv/patients.csv", "Id,GENDER,RACE\n1,F,white\n2,M,black\n")
    _write(f"{root}/a2/csv/patients.csv", "Id,RACE\n2,asian\n3,other\n")
    _write(f"{root}/a3/csv/patients.csv", "")
    _write(f"{root}/a4/csv/patients.csv", "Id,GENDER\n")
    paths = sorted(f"file:{root}/a{i}/csv/patients.csv" for i in range(1, 5))
    merged = I.merge_exports(spark, paths)
    assert merged.count() == 4
    d = I.dedup_keep_first(merged.withColumn("_row", F.monotonically_increasing_id()),
                           "Id", ["_src", "_row"]).drop("_src", "_row")
    got = {r.Id: (r.GENDER, r.RACE) for r in d.collect()}
    assert got == {"1": ("F", "white"), "2": ("M", "black"), "3": (None, "other")}
    rep = I.dedup_report(merged, d).collect()[0]
    assert (rep.rows_before, rep.rows_after, rep.removed) == (4, 3, 1)


def test_convert_exports_and_load_report(spark, root):
    _write(f"{root}/x/csv/conditions.csv",
           "START,STOP,PATIENT,CODE,DESCRIPTION,EXTRA\n2001-01-01,,p1,10,flu,z\n")
    _write(f"{root}/x/csv/payers.csv", "Id,NAME\n1,acme\n")
    _write(f"{root}/x/csv/immunizations.csv", "DATE,PATIENT\n2001-01-01,p1\n")  # CODE missing
    out = I.scratch_dir(spark, "test-out")
    rep = {r.table: r for r in I.convert_exports(spark, [f"file:{root}"], out).collect()}
    assert rep["conditions"].status == "ok" and rep["conditions"].rows == 1
    assert rep["payers"].status == "skipped" and rep["immunizations"].status == "error"
    assert rep["TOTAL"].status == "partial"
    cols = spark.read.parquet(f"{out}/conditions").columns
    assert cols == ["START", "STOP", "PATIENT", "CODE", "DESCRIPTION"]


def test_jsonl_tolerant_and_strict(spark, root):
    _write(f"{root}/s.jsonl", '{"text": "a", "label": "1"}\n{"text": "b"\n{"text": "c", "label": "2"}\n')
    assert I.read_jsonl(spark, f"file:{root}/s.jsonl").count() == 2
    with pytest.raises(Exception):
        I.read_jsonl(spark, f"file:{root}/s.jsonl", strict=True).collect()


def test_jsonl_sink_keeps_existing(spark, root):
    p = f"file:{root}/out"
    I.write_jsonl_if_absent(spark.createDataFrame([("a", "1")], "text string, label string"), p)
    I.write_jsonl_if_absent(spark.createDataFrame([("b", "2")], "text string, label string"), p)
    assert [r.text for r in I.read_jsonl(spark, p).collect()] == ["a"]


def test_required_columns_and_domain_config(spark):
    df = spark.createDataFrame([("p", "c"), (None, "c")], "prompt string, gold string")
    assert I.require_columns(df, ["prompt", "gold"]).count() == 1
    with pytest.raises(ValueError):
        I.require_columns(df, ["missing"])
    cfg = '{"cardio": {"codes": [1, "2"]}, "neuro": {"codes": [2]}, "bad": {"x": 1}}'
    m = {r.code: r.domain for r in I.load_domain_config(spark, cfg).collect()}
    assert m == {"1": "cardio", "2": "neuro"}
    assert I.load_domain_config(spark, None).count() == 0


def test_append_records_with_extras(spark, root):
    p = f"file:{root}/log"
    df = spark.createDataFrame([("routing", 120.5, True, "x")], "operation string, duration_ms double, "
                               "success boolean, model string")
    I.append_records(df, p, ["model"])
    I.append_records(df, p, ["model"])
    out = spark.read.parquet(p)
    assert out.count() == 2 and out.collect()[0].extra == {"model": "x"}


def test_result_documents_summary_csv_and_meta(spark, root):
    import json as _json
    from casebook.operators import explore as E
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "id long, label string, conf double")
    docs = [_json.loads(r.doc) for r in I.to_result_documents(df, ["id", "label", "conf"]).collect()]
    assert docs == [{"id": 1, "label": "a", "conf": 0.5}, {"id": 2, "label": "b"}]
    summary = E.describe(spark.createDataFrame([(float(v),) for v in range(1, 10)], "x double"), "x")
    p = f"file:{root}/summary"
    I.write_summary_csv(summary, p)
    stats = {r.stat: float(r.value) for r in spark.read.option("header", True).csv(p).collect()}
    assert list(stats) == ["n", "mean", "std", "min", "q25", "q50", "q75", "max"]
    assert stats["q50"] == 5.0 and stats["n"] == 9.0
    out = f"file:{root}/slice"
    I.write_with_meta(df, df.agg(F.count(F.lit(1)).alias("n_rows")), out)
    assert spark.read.json(f"{out}/meta").collect()[0].n_rows == 2
    assert spark.read.parquet(f"{out}/data").count() == 2


def test_header_only_and_empty_tables_are_reported_empty(spark, root):
    _write(f"{root}/e/csv/allergies.csv", "START,STOP,PATIENT,CODE,DESCRIPTION\n")
    _write(f"{root}/e/csv/immunizations.csv", "")
    out = I.scratch_dir(spark, "test-empty")
    rep = {r.table: r.status for r in I.convert_exports(spark, [f"file:{root}/e"], out).collect()}
    assert rep == {"allergies": "empty", "immunizations": "empty", "TOTAL": "success"}


def test_load_report_counts_duplicates(spark, root):
    _write(f"{root}/d1/csv/patients.csv", "Id,GENDER\n1,F\n2,M\n")
    _write(f"{root}/d2/csv/patients.csv", "Id,GENDER\n2,F\n3,M\n")
    out = I.scratch_dir(spark, "test-dups")
    rep = {r.table: r for r in I.convert_exports(spark, [f"file:{root}"], out,
                                                 {"patients": ["Id", "GENDER"]}).collect()}
    p = rep["patients"]
    assert (p.merged_rows, p.rows, p.duplicates_removed, p.removed_pct) == (4, 3, 1, 25.0)


def test_register_parquet_views_skips_files_and_bad_dirs(spark, root):
    spark.range(3).write.parquet(f"file:{root}/views/good_table")
    _write(f"{root}/views/not_a_dir.txt", "x")
    _write(f"{root}/views/bad_dir/readme.txt", "not parquet")
    done = I.register_parquet_views(spark, f"file:{root}/views")
    assert done == ["good_table"]
    assert spark.table("good_table").count() == 3


def test_merge_accepts_unqualified_paths(spark, root):
    _write(f"{root}/u1/csv/patients.csv", "Id,GENDER\n1,F\n")
    _write(f"{root}/u2/csv/patients.csv", "Id,GENDER\n1,M\n")
    merged = I.merge_exports(spark, [f"{root}/u1/csv/patients.csv", f"{root}/u2/csv/patients.csv"])
    assert [r._src.rsplit("/", 3)[1] for r in merged.orderBy("_src").collect()] == ["u1", "u2"]


def test_read_csv_columns_requires_file_and_columns(spark, root):
    _write(f"{root}/c.csv", "Id,BIRTHDATE,GENDER\n1,2000-01-01,F\n")
    df = I.read_csv_columns(spark, f"file:{root}/c.csv", ["Id", "GENDER"])
    assert [tuple(r) for r in df.collect()] == [("1", "F")]
    with pytest.raises(ValueError):
        I.read_csv_columns(spark, f"file:{root}/c.csv", ["Id", "RACE"])
    with pytest.raises(Exception):
        I.read_csv_columns(spark, f"file:{root}/missing.csv", ["Id"])


def test_domain_split_reader_falls_back_to_everything(spark, root):
    from casebook.operators import splits as S
    p = f"file:{root}/ds"
    spark.createDataFrame([(1, "cardio", "train"), (2, "cardio", "test")],
                          "patient_id long, domain string, split string") \
        .write.partitionBy("domain", "split").parquet(p)
    stored = spark.read.parquet(p)
    assert S.read_domain_split(stored, "cardio", "test").count() == 1
    assert S.read_domain_split(stored, "neuro", "test").count() == 2   # no own, no general


def test_headers_come_from_one_job(spark, root):
    _write(f"{root}/h/a.csv", "Id,X\n1,a\n")
    _write(f"{root}/h/b c+%.csv", '"Id","Y, or Z"\n2,b\n')
    _write(f"{root}/h/e.csv", "")
    paths = [f"file:{root}/h/{n}.csv" for n in ("a", "b c+%", "e")]
    assert I.headers_of(spark, paths) == {paths[0]: ["Id", "X"], paths[1]: ["Id", "Y, or Z"], paths[2]: None}


def test_exports_at_any_depth_and_blanks_in_paths(spark, root):
    for i, place in enumerate(("csv", "one/csv", "two words/deep+er/csv", "a[1]/b/c/csv")):
        _write(f"{root}/{place}/immunizations.csv", f"DATE,PATIENT,CODE\n200{i}-01-01,p{i},14{i}\n")
    out = I.scratch_dir(spark, "test-depth")
    rep = {r.table: r for r in I.convert_exports(spark, [f"file:{root}"], out).collect()}
    assert (rep["immunizations"].rows, rep["immunizations"].files) == (4, 4)
    assert {r.PATIENT for r in spark.read.parquet(f"{out}/immunizations").collect()} == {"p0", "p1", "p2", "p3"}


def test_quoted_fields_survive_read_and_write(spark, root):
    _write(f"{root}/q/csv/conditions.csv",
           '"START",STOP,PATIENT,CODE,"DESCRIPTION"\n2001-01-01,,p1,10,"a ""b"", c"\n'
           '2001-01-02,2001-02-30,p2,11,"line one\nline two"\n')
    out = I.scratch_dir(spark, "test-quotes")
    rep = {r.table: r for r in I.convert_exports(spark, [f"file:{root}"], out).collect()}
    assert (rep["conditions"].status, rep["conditions"].rows, rep["conditions"].rejected_dates) == ("ok", 2, 1)
    df = spark.read.parquet(f"{out}/conditions")
    assert df.schema["START"].dataType.typeName() == "date"
    want = {"p1": 'a "b", c', "p2": "line one\nline two"}
    assert {r.PATIENT: r.DESCRIPTION for r in df.collect()} == want
    again = f"{out}/csv"
    I.write_csv(df.select("PATIENT", "DESCRIPTION"), again)
    back = I.read_csv_tolerant(spark, I.find_files(spark, again, ".csv"), ["PATIENT", "DESCRIPTION"])
    assert {r.PATIENT: r.DESCRIPTION for r in back.collect()} == want


def test_dedup_key_counts_although_it_is_pruned(spark, root):
    _write(f"{root}/k/csv/conditions.csv", "Id,START,STOP,PATIENT,CODE,DESCRIPTION\n"
           "7,2001-01-01,,p1,10,first\n7,2001-01-01,,p1,10,second\n8,2001-01-01,,p1,10,third\n")
    out = I.scratch_dir(spark, "test-pruned-key")
    I.convert_exports(spark, [f"file:{root}"], out)
    df = spark.read.parquet(f"{out}/conditions")
    assert "Id" not in df.columns and sorted(r.DESCRIPTION for r in df.collect()) == ["first", "third"]


def test_router_config_and_result_document(spark, root):
    import json as _json
    _write(f"{root}/router.json", _json.dumps({"cardio": {"keywords": ["chest pain"], "agent_id": "c1"},
                                               "gi": {"keywords": ["nausea", "ulcer"], "agent_id": "g1"}}))
    routes = I.load_router_config(spark, f"file:{root}/router.json")
    assert [(d.name, d.keywords, d.agent_id) for d in routes] == [
        ("cardio", ("chest pain",), "c1"), ("gi", ("nausea", "ulcer"), "g1")]
    with pytest.raises(FileNotFoundError):
        I.load_router_config(spark, f"file:{root}/none.json")
    _write(f"{root}/bad.json", '{"cardio": {"keywords": []}}')
    with pytest.raises(ValueError):
        I.load_router_config(spark, f"file:{root}/bad.json")
    preds = spark.createDataFrame([(1, "a")], "sample_index long, predicted string")
    summary = spark.createDataFrame([(2, 0.5)], "processed long, accuracy double")
    I.result_document(preds, summary, {"model": "m", "seed": 3}, f"file:{root}/run")
    doc = _json.loads(spark.read.text(f"file:{root}/run/document").first()[0])
    assert doc == {"metadata": {"model": "m", "seed": 3}, "metrics": {"processed": 2, "accuracy": 0.5}}
    assert spark.read.parquet(f"file:{root}/run/predictions").count() == 1


def test_kinds_widen_to_a_type(spark):
    from pyspark.sql import functions as F
    rows = [("1", "1", "1.5", "True", "1", "x", None, "9223372036854775807", "007", " 5 "),
            ("2", "NaN", "2", "false", "True", "NA", "", "9223372036854775808", "8", "-3"),
            (None, "-3", "1e5", "n/a", "", "1", "null", "1", "null", "+4")]
    names = ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    types = I.infer_types(df)
    assert types == {"a": "bigint", "b": "bigint", "c": "double", "d": "boolean", "e": "string", "f": "string",
                     "g": "string", "h": "string", "i": "bigint", "j": "bigint"}
    out = [tuple(r) for r in I.typed(df, types).orderBy("a").collect()]
    assert out[1] == (1, 1, 1.5, True, "1", "x", None, "9223372036854775807", 7, 5)
    assert out[0] == (None, -3, 100000.0, None, None, "1", None, "1", None, 4)
    # kinds of parts merge to the kinds of the whole
    parts = [df.limit(1), df.exceptAll(df.limit(1))]
    merged = {n: 0 for n in names}
    for p in parts:
        seen = p.agg(*I.kinds_seen(names)).first()
        merged = {n: merged[n] | (seen[n] or 0) for n in names}
    assert {n: I.type_of(k) for n, k in merged.items()} == types
    assert I.infer_types(df.limit(0)) == {n: "string" for n in names}


def test_converted_tables_are_typed(spark, root):
    _write(f"{root}/t1/csv/observations.csv",
           'DATE,PATIENT,ENCOUNTER,CODE,DESCRIPTION,VALUE,UNITS\n2001-01-01,p1,e1,8302-2,"a\nb",1,cm\n')
    _write(f"{root}/t2/csv/observations.csv",
           "DATE,PATIENT,ENCOUNTER,CODE,DESCRIPTION,VALUE,UNITS\nbad,p2,e2,1,c,2.5,NA\n")
    out = I.scratch_dir(spark, "typed")
    rep = {r.table: r for r in I.convert_exports(spark, [f"file:{root}"], out).collect()}
    assert (rep["observations"].rows, rep["observations"].rejected_dates) == (2, 1)
    got = spark.read.parquet(f"{out}/observations")
    kinds = dict(got.dtypes)
    assert kinds["VALUE"] == "double" and kinds["CODE"] == "string" and kinds["DATE"] == "date"
    assert sorted((r.PATIENT, r.DESCRIPTION, r.VALUE, r.UNITS) for r in got.collect()) == [
        ("p1", "a\nb", 1.0, "cm"), ("p2", "c", 2.5, None)]
