"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus the matching oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casebook.operators import corpus
from casebook.plans import oracle as O
from casebook.sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- corpus (flagship)

@register("corpus_prompts", O.corpus_prompts_sql(True))
def q_corpus_prompts(spark, sf):
    return corpus.corpus_samples(V.conditions(spark, sf), V.patients(spark, sf), True)


@register("corpus_prompts_novel", O.corpus_prompts_sql(False))
def q_corpus_prompts_novel(spark, sf):
    return corpus.corpus_samples(V.conditions(spark, sf), V.patients(spark, sf), False)


@register("corpus_count", O.corpus_count_sql(False))
def q_corpus_count(spark, sf):
    return corpus.count_samples(
        corpus.corpus_labels(V.conditions(spark, sf), V.patients(spark, sf), False))


# ---------------------------------------------------------------- exploration

from casebook.operators import explore as E  # noqa: E402
from casebook.sources.tables import read_table  # noqa: E402

X = O.EXPLORE


@register("table_counts", X["table_counts"])
def q_table_counts(spark, sf):
    return E.table_counts({
        "patients": V.patients(spark, sf), "conditions": V.conditions(spark, sf),
        "observations": V.observations(spark, sf), "encounters": V.encounters(spark, sf),
        "medications": V.line_views(spark, sf, "medications"),
        "procedures": V.line_views(spark, sf, "procedures"),
        "allergies": V.line_views(spark, sf, "allergies"),
        "immunizations": V.immunizations(spark, sf)})


@register("gender_counts", X["gender_counts"])
def q_gender_counts(spark, sf):
    return E.value_counts(E.clean_demographics(V.patients(spark, sf), O.AS_OF), "GENDER")


@register("age_histogram", X["age_histogram"])
def q_age_histogram(spark, sf):
    return E.equal_width_histogram(E.clean_demographics(V.patients(spark, sf), O.AS_OF), "age", 30)


def _top_view(view_fn, keys, label):
    def q(spark, sf):
        return E.top_by_frequency(view_fn(spark, sf), keys, 20, label)
    return q


register("top_encounters", X["top_encounters"])(
    _top_view(V.encounters, ["DESCRIPTION"], "DESCRIPTION"))
register("top_observations", X["top_observations"])(
    _top_view(V.observations, ["DESCRIPTION"], "DESCRIPTION"))
register("top_immunizations", X["top_immunizations"])(
    _top_view(V.immunizations, ["CODE"], "CODE"))
register("top_conditions", X["top_conditions"])(
    _top_view(V.conditions, ["DESCRIPTION", "CODE"], "DESCRIPTION"))


def _top_line_view(name):
    # lineitem ⋈ part views: count per part key first, then attach the part attribute.
    def q(spark, sf):
        counts = E.frequency_through_dimension(
            read_table(spark, sf, "lineitem"), "l_partkey", read_table(spark, sf, "part"),
            "p_partkey", V.LINE_VIEW_ATTR[name]).withColumnRenamed(V.LINE_VIEW_ATTR[name],
                                                                   "DESCRIPTION")
        return E.top_by_frequency(None, ["DESCRIPTION"], 20, "DESCRIPTION", counts=counts)
    return q


for _name in ("medications", "procedures", "allergies"):
    register(f"top_{_name}", X[f"top_{_name}"])(_top_line_view(_name))


@register("conditions_per_patient_summary", X["conditions_per_patient_summary"])
def q_cpp_summary(spark, sf):
    return E.describe(E.count_per_key(V.conditions(spark, sf), "PATIENT"), "n")


@register("conditions_hist", X["conditions_hist"])
def q_conditions_hist(spark, sf):
    return E.equal_width_histogram(E.count_per_key(V.conditions(spark, sf), "PATIENT"), "n", 50)


@register("value_summary", X["value_summary"])
def q_value_summary(spark, sf):
    return E.describe(E.numeric_values(V.observations(spark, sf), O.OBS_KIND), "value")


@register("value_histogram", X["value_histogram"])
def q_value_histogram(spark, sf):
    return E.equal_width_histogram(E.numeric_values(V.observations(spark, sf), O.OBS_KIND),
                                   "value", 50)


@register("age_by_encounter", X["age_by_encounter"])
def q_age_by_encounter(spark, sf):
    return E.age_at_encounter(V.encounters(spark, sf), V.patients(spark, sf), 10)


@register("age_boxplot", X["age_boxplot"])
def q_age_boxplot(spark, sf):
    return E.box_stats(E.age_at_encounter(V.encounters(spark, sf), V.patients(spark, sf), 10),
                       "DESCRIPTION", "age_at_encounter")


@register("conditions_vs_encounters", X["conditions_vs_encounters"])
def q_cond_vs_enc(spark, sf):
    return E.conditions_vs_encounters(V.conditions(spark, sf), V.encounters(spark, sf))


@register("conditions_vs_encounters_pairs", X["conditions_vs_encounters_pairs"])
def q_cond_vs_enc_pairs(spark, sf):
    return E.pair_counts(E.conditions_vs_encounters(V.conditions(spark, sf),
                                                    V.encounters(spark, sf)),
                         "num_conditions", "num_encounters")


# ---------------------------------------------------------------- metrics

from casebook.operators import metrics as M  # noqa: E402

MX = O.METRICS


def _ok(spark, sf):
    return M.usable_rows(V.predictions(spark, sf))


@register("prediction_rows", MX["prediction_rows"])
def q_prediction_rows(spark, sf):
    from pyspark.sql import functions as F
    return M.processed_rows(V.predictions(spark, sf)).withColumn("confidence",
                                                                F.round("confidence", 6))


register("run_summary", MX["run_summary"])(
    lambda spark, sf: M.run_summary(V.predictions(spark, sf), patient="patient", seconds="seconds"))
register("accuracy", MX["accuracy"])(
    lambda spark, sf: M.accuracy(M.diagnosis_records(V.predictions(spark, sf))))
register("prf_one_class", MX["prf_one_class"])(
    lambda spark, sf: M.prf_for(M.diagnosis_records(V.predictions(spark, sf)), O.CONDITION))
register("class_report", MX["class_report"])(lambda spark, sf: M.class_report(_ok(spark, sf)))
register("averaged_f1", MX["averaged_f1"])(lambda spark, sf: M.overall_scores(_ok(spark, sf)))


register("confusion_matrix", MX["confusion_matrix"])(lambda spark, sf: M.confusion_matrix(_ok(spark, sf)))

REPORT_LABELS = 10      # the grid's own parameter: a dense matrix over the commonest labels


@register("confusion_grid", MX["confusion_grid"])
def q_confusion_grid(spark, sf):
    ok = _ok(spark, sf)
    return M.confusion_matrix(ok, M.top_labels(ok, "true_diagnosis", REPORT_LABELS), dense=True)


def _codes(spark, sf):
    """Predictions with hundreds of classes: each line's part size and brand against the next size."""
    p = _rt(spark, sf, "part")
    return p.select(F.concat_ws("/", "p_brand", "p_size").alias("true_diagnosis"),
                    F.when(F.col("p_partkey") % 11 > 0, F.concat_ws("/", "p_brand", (
                        F.col("p_size") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)).cast("string")))
                    .alias("predicted_diagnosis"))


register("confusion_many", MX["confusion_many"])(lambda spark, sf: M.confusion_matrix(_codes(spark, sf)))
register("latency_report", MX["latency_report"])(
    lambda spark, sf: M.latency_stats(V.latencies(spark, sf)))
register("agent_usage", MX["agent_usage"])(lambda spark, sf: M.agent_usage(_ok(spark, sf)))
register("agent_accuracy", MX["agent_accuracy"])(lambda spark, sf: M.agent_accuracy(_ok(spark, sf)))
register("calibration_fixed", MX["calibration_fixed"])(
    lambda spark, sf: M.calibration_fixed(_ok(spark, sf)))
register("calibration_adaptive", MX["calibration_adaptive"])(
    lambda spark, sf: M.calibration_adaptive(_ok(spark, sf)))
register("confidence_hist", MX["confidence_hist"])(
    lambda spark, sf: M.confidence_histogram(_ok(spark, sf)))
register("prefix_filtered_eval", MX["prefix_filtered_eval"])(
    lambda spark, sf: M.prefix_filter(V.predictions(spark, sf), O.PREFIX, ("true_diagnosis",))
    .select("sample_id", "true_diagnosis", "predicted_diagnosis"))


@register("metrics_report", MX["metrics_report"])
def q_metrics_report(spark, sf):
    preds = V.predictions(spark, sf)
    labels = M.labels_seen(M.usable_rows(preds), "true_diagnosis", "predicted_diagnosis")
    return M.metrics_report(M.diagnosis_records(preds), V.latencies(spark, sf), labels)


# ---------------------------------------------------------------- routing / voting / parsing

from pyspark.sql import functions as F  # noqa: E402

from casebook.operators import answers as A  # noqa: E402
from casebook.operators import consensus as C  # noqa: E402
from casebook.operators import routing as R  # noqa: E402

VT = O.VOTING


def _routed(spark, sf):
    # the text tables of the tests are one row group each: dealt out over the cores
    return R.route(V.notes(spark, sf), partitions=spark.sparkContext.defaultParallelism)


def _fanout(spark, sf):
    return R.fan_out(_routed(spark, sf), V.agent_answers(spark, sf))


@register("route_notes", VT["route_notes"])
def q_route_notes(spark, sf):
    return _routed(spark, sf).select("note_id", F.array_join("agents", ",").alias("agents"),
                                     F.size("agents").cast("long").alias("n_agents"))


@register("route_phrases", VT["route_phrases"])
def q_route_phrases(spark, sf):
    """T1 with a keyword list too long for a regex: the opening words of every benchmark passage."""
    words = F.split(F.trim("text"), r"[ \t\n\x0B\f\r]+")
    phrases = _rt(spark, sf, "benchmark").select(
        F.lit("phrases").alias("domain"), F.concat_ws(" ", F.slice(words, 1, 2)).alias("keyword"),
        F.concat(F.lit("agent"), (F.col("item_id") % 7).cast("string")).alias("agent_id"))
    routed = R.route(V.notes(spark, sf), routes=R.routes_from(phrases),
                     partitions=spark.sparkContext.defaultParallelism)
    return routed.select("note_id", F.array_join("agents", ",").alias("agents"))


register("route_summary", VT["route_summary"])(
    lambda spark, sf: R.route_summary(_routed(spark, sf)))
register("route_fanout", VT["route_fanout"])(
    lambda spark, sf: _fanout(spark, sf).select("case_id", "agent_id", "diagnosis",
                                                F.round("confidence", 6).alias("confidence")))


def _round_score(df):
    return df.withColumn("score", F.round("score", 6))


register("vote_softmax", VT["vote_softmax"])(
    lambda spark, sf: _round_score(C.vote(V.agent_answers(spark, sf), "softmax")))
register("vote_majority", VT["vote_majority"])(
    lambda spark, sf: _round_score(C.vote(V.agent_answers(spark, sf), "majority")))


@register("vote_scores", VT["vote_scores"])
def q_vote_scores(spark, sf):
    t = C.score_table(V.agent_answers(spark, sf))
    return t.select("case_id", "diagnosis", F.col("n_votes").cast("long").alias("n_votes"),
                    *[F.round(c, 6).alias(c) for c in ("avg_confidence", "median_confidence",
                                                       "softmax_score", "majority_score")])


@register("case_pipeline", VT["case_pipeline"])
def q_case_pipeline(spark, sf):
    out = C.case_pipeline(_fanout(spark, sf))
    return out.select("case_id", "softmax_diagnosis", F.round("softmax_score", 6).alias("softmax_score"),
                      "majority_diagnosis", F.round("majority_score", 6).alias("majority_score"))


def _candidates(spark, sf):
    from casebook.functions.columns import clamp01
    return _fanout(spark, sf).select("case_id", "agent_id", F.col("diagnosis").alias("answer"),
                                     clamp01("confidence").alias("confidence"), "answer_seq")


register("refine_prompt", VT["refine_prompt"])(
    lambda spark, sf: A.refinement_prompts(
        V.notes(spark, sf).withColumnRenamed("note_id", "case_id"), _candidates(spark, sf)))
register("refine_numbered", VT["refine_numbered"])(
    lambda spark, sf: A.numbered_agent_list(
        V.notes(spark, sf).withColumnRenamed("note_id", "case_id"), _candidates(spark, sf)))


@register("refine_parse", VT["refine_parse"])
def q_refine_parse(spark, sf):
    p = A.parse_refined(V.refined_outputs(spark, sf))
    return p.select("case_id", "line", "reject_reason", "ok", "diagnosis", "reasoning",
                    F.round("confidence", 6).alias("confidence"))


@register("sectioned_answer", VT["sectioned_answer"])
def q_sectioned_answer(spark, sf):
    p = A.parse_sections(V.sectioned_answers(spark, sf))
    return p.select("case_id", "line", "part", "primary",
                    F.array_join("secondary", ",").alias("secondary"),
                    F.size("secondary").cast("long").alias("n_secondary"), "rationale")


@register("delimited_answers", VT["delimited_answers"])
def q_delimited_answers(spark, sf):
    p = A.parse_delimited(V.delimited_lines(spark, sf))
    return p.select("case_id", "part", "reject_reason", "ok", "agent_id", "diagnosis",
                    F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- domains, splits, eval slice

from casebook.operators import evalslice as ES  # noqa: E402
from casebook.operators import splits as S  # noqa: E402

SP = O.SPLITS


def _samples(spark, sf):
    return corpus.corpus_samples(V.conditions(spark, sf), V.patients(spark, sf), True)


def _labels(spark, sf):
    return corpus.corpus_labels(V.conditions(spark, sf), V.patients(spark, sf), True)


def _domain_samples(spark, sf):
    return S.domain_samples(_labels(spark, sf), V.domain_map(spark, sf))


register("domain_corpus", SP["domain_corpus"])(
    lambda spark, sf: _domain_samples(spark, sf).select("patient_id", "label", "domain"))
register("domain_stats", SP["domain_stats"])(
    lambda spark, sf: S.domain_stats(_domain_samples(spark, sf)))
register("corpus_split", SP["corpus_split"])(
    lambda spark, sf: S.split_domains(_domain_samples(spark, sf))
    .select("patient_id", "label", "domain", "split"))
register("stratified_split", SP["stratified_split"])(
    lambda spark, sf: S.stratified_split(V.labelled_docs(spark, sf), "doc_id", "label", 0.25)
    .select("doc_id", "label", "split"))
register("sample_examples", SP["sample_examples"])(
    lambda spark, sf: S.sample_examples(_labels(spark, sf), "patient_id", 5)
    .select("patient_id", "label"))
register("prompt_expected_split", SP["prompt_expected_split"])(
    lambda spark, sf: S.with_prompt_expected(_samples(spark, sf))
    .select("patient_id", "prompt", "expected"))


def _slice(spark, sf):
    return ES.build_slice(V.patients(spark, sf), V.conditions(spark, sf))


register("eval_slice_last_condition", SP["eval_slice_last_condition"])(_slice)
register("eval_slice_meta", SP["eval_slice_meta"])(lambda spark, sf: ES.slice_meta(_slice(spark, sf)))
register("eval_slice_sample", SP["eval_slice_sample"])(
    lambda spark, sf: ES.stratified_sample(_slice(spark, sf), O.SAMPLE_N))


# ---------------------------------------------------------------- validation (V1–V4)

from casebook.operators import validate as VAL  # noqa: E402
from casebook.sources.patient_json import patient_records  # noqa: E402

VA = O.VALIDATION


@register("validate_records", VA["validate_records"])
def q_validate_records(spark, sf):
    v = VAL.validate(patient_records(spark, sf))
    return v.select("record_id", "is_valid", F.size("errors").cast("long").alias("n_errors"),
                    F.array_join(F.transform("errors", lambda e: e["code"]), ",").alias("error_codes"),
                    F.array_join(F.transform("errors", lambda e: e["message"]), " | ").alias("messages"))


register("validation_report", VA["validation_report"])(
    lambda spark, sf: VAL.quality_report(VAL.validate(patient_records(spark, sf))))


@register("sanitize_records", VA["sanitize_records"])
def q_sanitize_records(spark, sf):
    s = VAL.sanitize(patient_records(spark, sf))
    return s.select("record_id", "age", "gender", "ethnicity", "race",
                    F.array_join("symptoms", "|").alias("symptoms"),
                    F.array_join("icd10", ",").alias("icd10"),
                    F.size("medications").cast("long").alias("n_medications"),
                    F.array_join(F.transform("medications", lambda m: m["name"]), ",")
                    .alias("medication_names"), "dob")


register("emergency_flags", VA["emergency_flags"])(
    lambda spark, sf: VAL.emergency(patient_records(spark, sf))
    .select("record_id", "is_emergency", "emergency_reason"))


# ---------------------------------------------------------------- ingest round trips

from casebook.sources import ingest as I  # noqa: E402
from casebook.sources.tables import read_table as _rt  # noqa: E402

IG = O.INGEST


def _export_event_archives(spark, sf, root):
    """Write events as two CSV 'archives' (many part files each) with different headers, quoted
    fields, bad and short lines."""
    e = _rt(spark, sf, "events")
    # a quoted field holding a comma and doubled quotes
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit(', ""q"""'))
    a = e.where(F.col("event_id") % 2 == 0).select(F.concat_ws(
        ",", F.col("event_id").cast("string"), F.col("user_id").cast("string"),
        F.when(F.col("event_id") % 4 == 0, quoted).otherwise(F.col("event_type")),
        F.col("value").cast("string"),
        F.when(F.col("event_id") % 50 == 0, F.lit("x"))).alias("value"))
    b = e.where((F.col("event_id") % 2 == 1) | (F.col("event_id") % 6 == 0)).select(
        F.when(F.col("event_id") % 9 == 1, F.concat_ws(",", F.col("event_id").cast("string"),
                                                        "event_type"))
         .otherwise(F.concat_ws(",", F.col("event_id").cast("string"), "event_type",
                                F.col("user_id").cast("string"))).alias("value"))
    for name, body, header in (("a", a, "Id,user_id,event_type,value"),
                               ("b", b, "Id,event_type,user_id")):
        # lines are ready-made: a separator and a quote that don't occur leave them as they are
        body.withColumnRenamed("value", header).write.mode("overwrite").option("header", True) \
            .option("sep", "\x01").option("quote", "\x02").csv(f"{root}/{name}/csv")
    return [p for n in ("a", "b") for p in I.find_files(spark, f"{root}/{n}/csv", ".csv")]


@register("merge_tables", IG["merge_tables"])
def q_merge_tables(spark, sf):
    root = I.scratch_dir(spark, "merge")
    paths = _export_event_archives(spark, sf, root)
    merged = I.merge_exports(spark, paths)
    d = I.dedup_keep_first(merged.select("Id", "user_id", "event_type", "value", "_src", "_row"),
                           "Id", ["_src", "_row"])
    return d.select(F.col("Id").cast("long").alias("Id"), F.col("user_id").cast("long").alias("user_id"),
                    "event_type", F.col("value").cast("double").alias("value"))


def _export_conditions(spark, sf, root):
    cond = V.conditions(spark, sf).select("START", "STOP", "PATIENT", "CODE", "DESCRIPTION")
    I.write_csv(cond, f"{root}/archive1/csv/conditions")
    I.write_csv(V.patients(spark, sf).select(F.col("ID").alias("Id"), "GENDER"),
                f"{root}/archive1/csv/payers")       # not in the allow-list -> skipped
    return root


def _convert(spark, sf):
    root = I.scratch_dir(spark, "export")
    _export_conditions(spark, sf, root)
    out = I.scratch_dir(spark, "parquet")
    # Spark writes a directory per CSV "file": expose its part files as the table's inputs.
    tables = {"conditions": I.list_files(spark, f"{root}/archive1/csv/conditions/part-*.csv"),
              "payers": I.list_files(spark, f"{root}/archive1/csv/payers/part-*.csv")}
    results = []
    for name, paths in tables.items():
        if name not in I.KEEP_COLUMNS:
            results.append(I.TableResult(name, "skipped", message="not in allow-list"))
        else:
            results.append(I.convert_table(spark, name, paths, out))
    return out, I.load_report(spark, results)


@register("csv_parquet_roundtrip", IG["csv_parquet_roundtrip"])
def q_csv_parquet_roundtrip(spark, sf):
    out, _ = _convert(spark, sf)
    return spark.read.parquet(f"{out}/conditions")


@register("typed_ingest", IG["typed_ingest"])
def q_typed_ingest(spark, sf):
    """An all-text export whose columns get the narrowest type that holds their values."""
    root, e = I.scratch_dir(spark, "typed"), V.read_table(spark, sf, "events")
    every = lambda n: F.col("event_id") % n == 0
    number = F.col("event_id").cast("string")
    I.write_csv(e.select(
        F.col("event_id").alias("Id"),
        F.when(every(5), "n/a").otherwise(F.col("user_id").cast("string")).alias("USER_ID"),
        F.when(every(3), (F.col("event_id") % 100).cast("string")).otherwise(F.col("value").cast("string"))
         .alias("VALUE"),
        F.when(every(2), "True").otherwise("False").alias("FLAG"),
        F.when(every(2), "True").otherwise(number).alias("MIXED"),
        F.when(every(7), F.concat(F.lit("1"), F.lpad(number, 20, "0"))).otherwise(number).alias("BIG"),
        F.when(every(4), "NaN").otherwise(F.concat("event_type", F.lit('\n"x", y'))).alias("TYPE"),
        F.col("ts").cast("date").alias("DATE"), F.lit("").alias("NOTHING")), f"{root}/csv")
    out = I.scratch_dir(spark, "typed-out")
    I.convert_table(spark, "events", I.find_files(spark, f"{root}/csv", ".csv"), out, keep="*")
    return spark.read.parquet(f"{out}/events")


@register("load_report")
def q_load_report(spark, sf):
    _, report = _convert(spark, sf)
    return report


@register("jsonl_roundtrip", IG["jsonl_roundtrip"])
def q_jsonl_roundtrip(spark, sf):
    path = I.scratch_dir(spark, "jsonl")
    samples = _samples(spark, sf)
    I.write_jsonl_if_absent(samples.select("text", "label"), path)
    # malformed lines in the same folder: the tolerant reader drops them
    samples.where(F.col("patient_id") % 10 == 0).select(
        F.concat(F.lit('{"text": "'), F.col("label")).alias("value")).write.mode("append").text(path)
    return I.read_jsonl(spark, path)


@register("dedup_latest", IG["dedup_latest"])
def q_dedup_latest(spark, sf):
    o = _rt(spark, sf, "orders").select(F.col("o_custkey").alias("Id"), "o_orderkey", "o_orderdate",
                                        "o_orderpriority")
    return I.dedup_keep_first(o, "Id", ["o_orderkey"]).select("Id", "o_orderkey", "o_orderdate",
                                                               "o_orderpriority")


# ---------------------------------------------------------------- loads one after the other

from casebook.operators import state as ST  # noqa: E402
from casebook.sources import timeline as TL  # noqa: E402
from casebook.sources.keystore import KeyStore  # noqa: E402

LO = O.LOADS


def _event_loads(spark, sf):
    """Three overlapping exports of the events; a later one repeats ids with other values."""
    e = V.read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    for i in range(3):
        part = e.where((F.col("event_id") % 3 == i) | (F.col("event_id") % 7 == i) | (F.col("event_id") % 11 == 0))
        yield f"part{i}", part.select(
            F.when(F.col("event_id") % 101 > 0, F.col("event_id")).alias("Id"), "user_id",
            F.concat("event_type", F.lit(f"/{i}")).alias("event_type"),
            *([F.col("value")] if i else []), F.col("event_id").alias("_row"))


def _merged_store(spark, sf):
    store = KeyStore(spark, I.scratch_dir(spark, "store"), "Id", buckets=16)
    return store, [store.merge(rows, name, ["_row"]) for name, rows in _event_loads(spark, sf)]


@register("incremental_merge", LO["incremental_merge"])
def q_incremental_merge(spark, sf):
    """S4 load by load: rows of the first load that had the key; later loads add what is new."""
    return _merged_store(spark, sf)[0].read().select("Id", "user_id", "event_type", "value")


@register("incremental_report", LO["incremental_report"])
def q_incremental_report(spark, sf):
    done = _merged_store(spark, sf)[1]
    return spark.createDataFrame([(r.load, r.rows_in, r.rows_new) for r in done],
                                 "load string, rows_in long, rows_new long")


def _states(spark, sf, kind):
    """A state per load of the conditions (loads are split by patient and order), merged from storage."""
    path = I.scratch_dir(spark, "states")
    cond = V.conditions(spark, sf)
    for i in range(3):
        part = cond.where(F.pmod(F.xxhash64("PATIENT", "START"), F.lit(3)) == i)
        ST.save(kind(part), path, f"part{i}")
    return ST.load_all(spark, path)


@register("cutoff_from_states", LO["cutoff_from_states"])
def q_cutoff_from_states(spark, sf):
    """The cutoff from the merged day histograms of the loads."""
    return ST.cutoff(_states(spark, sf, ST.day_counts), corpus.CUTOFF_QUANTILE)


@register("key_counts_from_states", LO["key_counts_from_states"])
def q_key_counts_from_states(spark, sf):
    """A5: conditions per patient, summarised from the merged counts of the loads."""
    s = ST.counts_summary(_states(spark, sf, lambda part: ST.key_counts(part, "PATIENT")))
    return s.select("n", *[F.round(c, 6).alias(c) for c in s.columns if c != "n"])


@register("distinct_from_states", LO["distinct_from_states"])
def q_distinct_from_states(spark, sf):
    """Distinct codes and patients from the merged value sets of the loads."""
    return ST.distinct_counts(_states(spark, sf, lambda part: ST.value_sets(part, ["CODE", "PATIENT"])))


@register("corpus_prompts_laid_out", LO["corpus_prompts_laid_out"])
def q_corpus_prompts_laid_out(spark, sf):
    """The flagship on timelines laid out by patient, its cutoff from the loads' histograms."""
    days = _states(spark, sf, ST.day_counts)
    cut = ST.cutoff(days, corpus.CUTOFF_QUANTILE)
    rows = days.agg(F.sum("n")).first()[0] or 0
    laid = TL.lay_out(V.conditions(spark, sf), buckets=TL.buckets_for(rows, least=16))
    return corpus.corpus_samples(laid, V.patients(spark, sf), False, cutoff=cut.scalar())


# ---------------------------------------------------------------- TF-IDF and baseline (M1–M3)

from casebook.operators import tfidf as TF  # noqa: E402


@register("tfidf_top_terms", O.TFIDF["tfidf_top_terms"])
def q_tfidf_top_terms(spark, sf):
    docs = _rt(spark, sf, "documents").select("doc_id", "text")
    return TF.top_terms_per_doc(docs, 5, partitions=spark.sparkContext.defaultParallelism)


@register("logit_baseline_report", O.BASELINE["logit_baseline_report"])
def q_logit_baseline_report(spark, sf):
    preds, n_features, n_train = TF.logit_baseline(V.labelled_docs(spark, sf))
    return TF.baseline_report(preds, n_features, n_train)


def _language_baseline(spark, sf):
    docs = _rt(spark, sf, "documents").select("doc_id", "text", "lang")
    return TF.fit_baseline(docs, label_col="lang", max_features=O.LANGUAGE_FEATURES)


@register("logit_models", O.BASELINE["logit_models"])
def q_logit_models(spark, sf):
    """One model per language against the rest; the optimum is where the gradient vanishes."""
    return _language_baseline(spark, sf).models().select(
        "label", "n_features", F.round("weight_norm", 4).alias("weight_norm"),
        F.round("intercept", 4).alias("intercept"), (F.col("gradient_norm") < 1e-6).alias("at_optimum"))


@register("logit_languages", O.BASELINE["logit_languages"])
def q_logit_languages(spark, sf):
    return (_language_baseline(spark, sf).predictions.groupBy("true_diagnosis", "predicted_diagnosis")
            .agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- coverage additions

MO = O.MORE


@register("distinct_counts", MO["distinct_counts"])
def q_distinct_counts(spark, sf):
    """Distinct codes, label classes, operations and domains (map domains + 'general')."""
    codes = V.conditions(spark, sf).agg(F.countDistinct("CODE")).scalar()
    classes = V.labelled_docs(spark, sf).agg(F.countDistinct("label")).scalar()
    ops = V.latencies(spark, sf).agg(F.countDistinct("operation")).scalar()
    doms = (V.domain_map(spark, sf).select("domain")
            .unionByName(spark.range(1).select(F.lit(S.GENERAL).alias("domain")))
            .agg(F.countDistinct("domain")).scalar())
    return spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("codes").alias("metric"), codes.alias("n")),
        F.struct(F.lit("label_classes").alias("metric"), classes.alias("n")),
        F.struct(F.lit("operations").alias("metric"), ops.alias("n")),
        F.struct(F.lit("domains").alias("metric"), doms.alias("n")))).alias("m")).select("m.*")


@register("prediction_rows_first_n", MO["prediction_rows_first_n"])
def q_prediction_rows_first_n(spark, sf):
    """L3: the first N stored prediction rows (N = 500)."""
    return M.processed_rows(V.predictions(spark, sf), limit=O.FIRST_N).withColumn(
        "confidence", F.round("confidence", 6))


@register("case_pipeline_refined", MO["case_pipeline_refined"])
def q_case_pipeline_refined(spark, sf):
    """T11 + U3: routed specialists' answers plus one parsed refined answer per case."""
    notes = V.notes(spark, sf).select(F.col("note_id").alias("case_id"))
    parsed = A.parse_refined(V.refined_outputs(spark, sf)).where("ok")
    one = (parsed.join(notes, "case_id", "left_semi")
           .groupBy("case_id").agg(F.min(F.struct("line", "diagnosis", "confidence")).alias("r")))
    refined = one.select("case_id", F.lit("refine").alias("agent_id"), "r.diagnosis",
                         "r.confidence", F.lit(O.REFINED_SEQ).alias("answer_seq"))
    out = C.case_pipeline(_fanout(spark, sf), refined)
    return out.select("case_id", "softmax_diagnosis", F.round("softmax_score", 6).alias("softmax_score"),
                      "majority_diagnosis", F.round("majority_score", 6).alias("majority_score"))


@register("domain_split_roundtrip", MO["domain_split_roundtrip"])
def q_domain_split_roundtrip(spark, sf):
    """Corpus split written partitioned by (domain, split), read back with fallback."""
    path = I.scratch_dir(spark, "domain-splits")
    split = S.split_domains(_domain_samples(spark, sf)).select("patient_id", "label", "domain", "split")
    split.write.mode("overwrite").partitionBy("domain", "split").parquet(path)
    stored = spark.read.parquet(path)
    own = S.read_domain_split(stored, "small", "train").withColumn("requested", F.lit("small/train"))
    fallback = S.read_domain_split(stored, "cardio", "test").withColumn("requested",
                                                                        F.lit("cardio/test"))
    return own.unionByName(fallback).select("requested", "patient_id", "label", "domain", "split")


@register("eval_slice_roundtrip", MO["eval_slice_roundtrip"])
def q_eval_slice_roundtrip(spark, sf):
    """Eval slice written as Parquet with its one-row metadata sidecar, read back."""
    path = I.scratch_dir(spark, "eval-slice")
    sl = _slice(spark, sf)
    I.write_with_meta(sl, ES.slice_meta(sl), path)
    return spark.read.parquet(f"{path}/data")


@register("label_encoding", MO["label_encoding"])
def q_label_encoding(spark, sf):
    """Labels encoded as positions among the sorted classes."""
    return TF.encode_labels(V.labelled_docs(spark, sf).select("doc_id", "label"))


# ---------------------------------------------------------------- operators with small results of their own

from casebook.operators.ordering import shuffle_key  # noqa: E402

EX = O.EXTRA


@register("empty_exports", EX["empty_exports"])
def q_empty_exports(spark, sf):
    """S3: an export without any line and one with a header alone add nothing to a merge."""
    root = I.scratch_dir(spark, "empty-exports")
    body = V.encounters(spark, sf).select("ID", "PATIENT", "DESCRIPTION")
    I.write_csv(body, f"{root}/full")
    I.write_csv(body.limit(0), f"{root}/header")
    spark.range(1).select(F.lit("").alias("value")).write.text(f"{root}/blank")
    merged = I.merge_exports(spark, I.find_files(spark, root, ".csv") + I.find_files(spark, root, ".txt"))
    return merged.groupBy("DESCRIPTION").agg(F.count(F.lit(1)).alias("n"))


@register("load_counts", EX["load_counts"])
def q_load_counts(spark, sf):
    """Status and row counts of the load report (its byte sizes depend on the writer)."""
    return q_load_report(spark, sf).select("table", "status", "rows", "merged_rows", "duplicates_removed",
                                           "rejected_dates")


@register("registered_views", EX["registered_views"])
def q_registered_views(spark, sf):
    """Tables registered as views and joined through SQL text."""
    from casebook.sources.tables import register_tables
    register_tables(spark, sf, ("orders", "customer", "nation"))
    return spark.sql("""SELECT n_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey
                        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")


@register("required_rows", EX["required_rows"])
def q_required_rows(spark, sf):
    """Rows that have all required values."""
    rows = I.require_columns(V.predictions(spark, sf), ["true_diagnosis", "predicted_diagnosis", "patient"])
    return rows.select("sample_id", "true_diagnosis", "predicted_diagnosis")


@register("result_documents", EX["result_documents"])
def q_result_documents(spark, sf):
    """One JSON text per stored prediction, read back field by field."""
    docs = I.to_result_documents(_ok(spark, sf), ["sample_id", "true_diagnosis", "correct"])
    parsed = F.from_json("doc", "sample_id long, true_diagnosis string, correct boolean")
    return docs.select(parsed.alias("r")).select("r.*")


@register("domain_config", EX["domain_config"])
def q_domain_config(spark, sf):
    """Conditions per domain of a JSON config; codes it doesn't list are 'general'."""
    config = I.load_domain_config(spark, O.DOMAIN_CONFIG)
    return (S.lookup_domain(V.conditions(spark, sf), "CODE", config)
            .groupBy("domain").agg(F.count(F.lit(1)).alias("n")))


@register("router_config", EX["router_config"])
def q_router_config(spark, sf):
    """Notes routed by keywords read from a config file."""
    path = I.scratch_dir(spark, "router")
    spark.range(1).select(F.lit(O.ROUTER_CONFIG).alias("value")).coalesce(1).write.text(path)
    routes = I.load_router_config(spark, I.find_files(spark, path, ".txt")[0])
    routed = R.route(V.notes(spark, sf), routes=routes)
    return routed.select("note_id", F.array_join("agents", ",").alias("agents"))


@register("summary_csv", EX["summary_csv"])
def q_summary_csv(spark, sf):
    """A describe() summary written as (stat, value) CSV rows and read back."""
    path = I.scratch_dir(spark, "summary-csv")
    I.write_summary_csv(E.describe(E.numeric_values(V.observations(spark, sf), O.OBS_KIND), "value"), path)
    return spark.read.option("header", True).csv(path).select("stat", F.col("value").cast("double").alias("value"))


@register("csv_column_subset", EX["csv_column_subset"])
def q_csv_column_subset(spark, sf):
    """Two columns of an export, by name."""
    path = I.scratch_dir(spark, "csv-subset")
    I.write_csv(V.conditions(spark, sf).select("START", "PATIENT", "CODE", "DESCRIPTION"), path)
    return I.read_csv_columns(spark, path, ["PATIENT", "CODE"])


@register("record_log", EX["record_log"])
def q_record_log(spark, sf):
    """Records appended in two batches, their open fields in a map."""
    path = I.scratch_dir(spark, "record-log")
    lat = V.latencies(spark, sf).withColumn("model", F.concat(F.lit("m_"), "operation"))
    for ok in (True, False):
        I.append_records(lat.where(F.col("success") == ok), path, ["model"])
    log = spark.read.parquet(path)
    return log.groupBy("operation", F.col("extra")["model"].alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_ms"), 3).alias("total_ms"))


@register("limited_samples", EX["limited_samples"])
def q_limited_samples(spark, sf):
    """L2: the first 25 samples by patient."""
    return corpus.limit_samples(_labels(spark, sf), O.FIRST_SAMPLES)


@register("score_maps", EX["score_maps"])
def q_score_maps(spark, sf):
    """The scores of a case as one map, shown as sorted text."""
    t = C.score_table(V.agent_answers(spark, sf)).select("case_id", "diagnosis",
                                                         F.col("softmax_score").alias("score"))
    entry = F.array_sort(F.transform(F.map_entries("scores"), lambda e: F.concat(
        e["key"], F.lit("="), F.round(e["value"] * 1000).cast("long").cast("string"))))
    return C.score_map(t).select("case_id", F.array_join(entry, ",").alias("scores"))


@register("dedup_counts", EX["dedup_counts"])
def q_dedup_counts(spark, sf):
    """Rows before and after keep-first de-duplication."""
    o = _rt(spark, sf, "orders").select(F.col("o_custkey").alias("Id"), "o_orderkey")
    return I.dedup_report(o, I.dedup_keep_first(o, "Id", ["o_orderkey"]))


def _text_tables(spark, sf):
    """Conditions and patients as an all-string export has them: text ids, dates as text, one
    condition in fifty with a date that is none."""
    ident = lambda c: F.concat(F.lit("id-"), F.col(c).cast("string"))
    cond = V.conditions(spark, sf)
    bad = shuffle_key(F.concat_ws("|", F.col("PATIENT").cast("string"), "CODE")) % 50 == 0
    start = F.when(bad, F.lit("unknown")).otherwise(F.col("START").cast("string"))
    pts = V.patients(spark, sf)
    return (cond.select(start.alias("START"), ident("PATIENT").alias("PATIENT"), "CODE", "DESCRIPTION"),
            pts.select(ident("ID").alias("ID"), F.col("BIRTHDATE").cast("string").alias("BIRTHDATE"),
                       "GENDER", "RACE", "ETHNICITY"))


@register("corpus_prompts_text_keys", EX["corpus_prompts_text_keys"])
def q_corpus_prompts_text_keys(spark, sf):
    """Samples from text ids and text dates, split by the hash of the id."""
    samples = corpus.corpus_samples(*_text_tables(spark, sf))
    return S.split_by_hash(samples, "patient_id").select("patient_id", "text", "label", "split")


@register("rejected_dates", EX["rejected_dates"])
def q_rejected_dates(spark, sf):
    """texts in date columns that are no dates, counted."""
    cond, pts = _text_tables(spark, sf)
    return corpus.rejected_dates(cond, "START").unionByName(corpus.rejected_dates(pts, "BIRTHDATE"))
