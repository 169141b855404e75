"""Scoring (A12–A22) — the reference's demo records plus traps."""
import random

import pytest

from casebook.operators import metrics as M

REC_SCHEMA = "patient_id string, predicted_diagnosis string, ground_truth string, confidence double"
DEMO = [("P001", "Hypertension", "Hypertension", 0.85),
        ("P002", "Type 2 Diabetes", "Type 2 Diabetes", 0.92),
        ("P003", "Asthma", "COPD", 0.67)]


def test_accuracy_demo(spark):
    r = M.accuracy(spark.createDataFrame(DEMO, REC_SCHEMA)).collect()[0]
    assert r.accuracy == pytest.approx(2 / 3, abs=1e-6)


def test_accuracy_empty_truth_counts_in_denominator(spark):
    data = DEMO + [("P004", "X", "", 0.1), ("P005", "X", None, 0.1)]
    r = M.accuracy(spark.createDataFrame(data, REC_SCHEMA)).collect()[0]
    assert (r.n_with_truth, r.n_correct) == (4, 2)


def test_prf_demo(spark):
    recs = spark.createDataFrame(DEMO, REC_SCHEMA)
    h = M.prf_for(recs, "Hypertension").collect()[0]
    assert (h.precision, h.recall, h.f1) == (1.0, 1.0, 1.0)
    for cond in ("COPD", "Asthma"):
        r = M.prf_for(recs, cond).collect()[0]
        assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_confusion_matrix_demo(spark):
    recs = spark.createDataFrame(DEMO, REC_SCHEMA)
    labels = spark.createDataFrame([("COPD",), ("Asthma",), ("Hypertension",)], "label string")
    cm = {(r.actual, r.predicted): r.n
          for r in M.confusion_matrix(recs, labels, "ground_truth", "predicted_diagnosis", True).collect()}
    assert len(cm) == 9 and cm[("COPD", "Asthma")] == 1 and cm[("Hypertension", "Hypertension")] == 1
    assert sum(cm.values()) == 2  # Type 2 Diabetes is outside the list


def test_latency_demo(spark):
    lat = spark.createDataFrame([("routing", 120.5), ("diagnosis", 850.2), ("diagnosis", 780.9)],
                                "operation string, duration_ms double")
    d = {r.operation: r for r in M.latency_stats(lat).collect()}
    dx = d["diagnosis"]
    assert (dx.avg_ms, dx.min_ms, dx.max_ms, dx["count"]) == (815.55, 780.9, 850.2, 2)
    assert dx.p95_ms == pytest.approx(846.735)
    assert d[None].is_overall and d[None]["count"] == 3


def _class_report_brute(pairs):
    labels = sorted({t for t, _ in pairs} | {p for _, p in pairs})
    out = {}
    for c in labels:
        tp = sum(1 for t, p in pairs if t == c and p == c)
        npred = sum(1 for _, p in pairs if p == c)
        ntrue = sum(1 for t, _ in pairs if t == c)
        pr = tp / npred if npred else 0.0
        rc = tp / ntrue if ntrue else 0.0
        f1 = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        out[c] = (pr, rc, f1, ntrue)
    n = sum(v[3] for v in out.values())
    out["macro avg"] = tuple(sum(v[i] for v in out.values()) / len(labels) for i in range(3)) + (n,)
    out["weighted avg"] = tuple(sum(v[i] * v[3] for k, v in out.items() if k in labels) / n
                                for i in range(3)) + (n,)
    return out


def test_class_report_matches_brute_force(spark):
    rnd = random.Random(7)
    pairs = [(rnd.choice("abcd"), rnd.choice("abcde")) for _ in range(200)]  # 'e' predicted only
    df = spark.createDataFrame(pairs, "true_diagnosis string, predicted_diagnosis string")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in M.class_report(df).collect()}
    want = _class_report_brute(pairs)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k][:3] == pytest.approx(v[:3], abs=1e-6) and got[k][3] == v[3]


def test_calibration_fixed_edges(spark):
    # 0.3 falls in bin 2 (linspace gives 0.30000000000000004); 1.0 and 1.2 fall in no bin
    df = spark.createDataFrame([(0.3, True), (1.0, True), (1.2, False), (0.05, False)],
                               "confidence double, correct boolean")
    b = {r.bin: (r.n, r.accuracy) for r in M.calibration_fixed(df).collect()}
    assert b[2] == (1, 1.0) and b[0] == (1, 0.0) and b[9] == (0, 0.0) and len(b) == 10


def test_calibration_adaptive_needs_more_than_ten_rows(spark):
    few = spark.createDataFrame([(0.1 * i, True) for i in range(10)], "confidence double, correct boolean")
    assert M.calibration_adaptive(few).count() == 0
    same = spark.createDataFrame([(0.5, i % 2 == 0) for i in range(12)], "confidence double, correct boolean")
    r = M.calibration_adaptive(same).collect()
    assert len(r) == 1 and r[0].n == 12


def test_skip_reasons_and_index(spark):
    df = spark.createDataFrame([(1, "a", "a", 0.1, "x"), (2, None, "a", 0.1, "x"), (3, "b", "", 0.1, "x"),
                                (4, "b", "a", 0.1, "y")],
                               "sample_id long, true_diagnosis string, predicted_diagnosis string, "
                               "confidence double, agent_used string")
    s = M.run_summary(df).collect()[0]
    assert (s.total, s.processed, s.skipped_missing_truth, s.skipped_missing_prediction) == (4, 2, 1, 1)
    p = M.processed_rows(df).orderBy("sample_id").collect()
    assert [(r.sample_id, r.sample_index, r.correct) for r in p] == [(1, 0, True), (4, 1, False)]
    assert M.processed_rows(df, limit=1).count() == 1


def test_latency_sketch_mode(spark):
    lat = spark.createDataFrame([("op", float(i)) for i in range(1, 1001)],
                                "operation string, duration_ms double")
    r = {x.operation: x for x in M.latency_stats(lat, exact=False).collect()}["op"]
    assert abs(r.p95_ms - 950.05) <= 2 and r["count"] == 1000


def test_exact_quantiles_equal_percentile_with_ties_and_nulls(spark):
    from pyspark.sql import functions as F

    from casebook.operators.quantiles import exact_quantiles
    rnd = random.Random(11)
    rows = ([("hot", rnd.random() * 100) for _ in range(8000)] + [("hot", 50.0)] * 8000     # half is one value
            + [("dup", 3.0)] * 300 + [("one", 1.0), ("null", None), (None, 4.0), (None, 6.0)])
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.25, 0.5, 0.95]
    pct = F.percentile("x", F.array(*[F.lit(q) for q in qs])).alias("p")
    ref = {r.g: r.p for r in df.where("x IS NOT NULL").groupBy("g").agg(pct).collect()}
    out = exact_quantiles(df, ["g"], "x", qs, ["a", "b", "c"])
    got = {r.g: (r.a, r.b, r.c) for r in out.collect()}
    assert got.keys() == ref.keys()
    for k, v in ref.items():
        assert got[k] == pytest.approx(tuple(v), abs=1e-12)
    whole = exact_quantiles(df, [], "x", qs, ["a", "b", "c"]).first()
    assert (whole.a, whole.b, whole.c) == pytest.approx(tuple(df.agg(pct).first()[0]), abs=1e-12)
    assert exact_quantiles(df.where("g = 'null'"), ["g"], "x", qs, ["a", "b", "c"]).count() == 0


def test_order_keys_are_the_bits_of_a_double(spark):
    import struct

    from casebook.operators.quantiles import with_order_key
    rnd = random.Random(5)
    values = [0.0, -0.0, 5e-324, 2.0 ** -1022, 2.0 ** -1022 - 5e-324, 1.0, 1.0 + 2 ** -52, 1.0 - 2 ** -53, 1.7976931348623157e308,
              float("inf"), 3.0, 0.1, 1e-310, 2.0 ** 1023, 2.0 ** 52, 7.0 / 3]
    values += [struct.unpack("<d", rnd.randbytes(8))[0] for _ in range(4000)]
    values = [v for v in values if v == v]
    values += [-v for v in values] + [2.0 ** e * m for e in range(-1074, 1024, 7) for m in (1, 0.9999999999999999)]

    def bits(v):
        n = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        return -n if v < 0 else n

    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.key for r in with_order_key(df, "x").collect()] == [bits(v) for v in values]
    nan = with_order_key(spark.createDataFrame([(float("nan"),)], "x double"), "x").first().key
    assert nan > bits(float("inf"))


def test_quantiles_of_awkward_values_and_totals(spark):
    from pyspark.sql import functions as F

    from casebook.operators.quantiles import exact_quantiles
    rnd = random.Random(12)
    rows = [(f"g{i % 7}", rnd.choice([-1, 1]) * 2.0 ** rnd.uniform(-40, 40)) for i in range(5000)]
    rows += [("near", 1.0 + i * 2 ** -52) for i in range(40)]         # equal but for the last bits
    rows += [("edge", v) for v in (-0.0, 0.0, float("inf"), -float("inf"), 5e-324)] + [("one", 7.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    out = exact_quantiles(df, ["g"], "x", qs, list("abcde"), total=True).collect()
    pct = F.percentile("x", F.array(*[F.lit(q) for q in qs])).alias("p")
    want = {r.g: list(r.p) for r in df.where("x IS NOT NULL").groupBy("g").agg(pct).collect()}
    got = {r.g: [r.a, r.b, r.c, r.d, r.e] for r in out if not r.is_total}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-15, nan_ok=True), k
    whole = next(r for r in out if r.is_total)
    assert whole.g is None and whole.n == 5046
    assert [whole.a, whole.b, whole.c, whole.d, whole.e] == pytest.approx(list(df.agg(pct).first()[0]), rel=1e-15)


def test_confusion_matrix_is_long_form_unless_dense(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "x"), ("c", "c")],
                                 "true_diagnosis string, predicted_diagnosis string")
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    assert sorted(map(tuple, M.confusion_matrix(rows, labels).collect())) == [("a", "b", 2), ("c", "c", 1)]
    assert M.confusion_matrix(rows).count() == 3 and M.labels_seen(rows, *rows.columns).count() == 4
    many = spark.range(40).selectExpr("id AS true_diagnosis", "CASE WHEN id > 0 THEN id % 5 END AS predicted_diagnosis")
    assert M.confusion_matrix(many).count() == 39
    with pytest.raises(ValueError):
        M.confusion_matrix(rows, dense=True)
    with pytest.raises(ValueError):
        M.confusion_matrix(rows, spark.range(1001).selectExpr("id AS label"), dense=True)
    dense = M.confusion_matrix(rows, labels, dense=True).collect()
    assert len(dense) == 9 and sum(r.n for r in dense) == 3


def test_run_summary_seconds_and_missing_patient(spark):
    df = spark.createDataFrame([("a", "a", None, 1.0), ("a", "b", 1, 2.0), ("a", None, 1, 9.0), ("b", "b", 2, 4.0)],
                               "true_diagnosis string, predicted_diagnosis string, p long, s double")
    r = M.run_summary(df, patient="p", seconds="s").first()
    assert (r.total, r.processed, r.skipped_missing_patient, r.skipped_missing_prediction) == (4, 2, 1, 1)
    assert (r.total_seconds, r.mean_seconds) == (6.0, 3.0)
    assert M.run_summary(df.limit(0)).first().mean_seconds == 0.0
