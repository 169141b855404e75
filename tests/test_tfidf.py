"""TF-IDF (M1): tokens, idf formula, normalisation and the two top-k paths."""
import math

import pytest
from pyspark.sql import functions as F

from casebook.operators import tfidf as TF


def _docs(spark):
    return spark.createDataFrame([(1, "Heart heart failure; the été été café_2 x"),
                                  (2, "heart attack and stroke"), (3, "the and of")],
                                 "doc_id long, text string")


def test_tokens_idf_and_norm(spark):
    w = {(r.doc_id, r.term): r for r in TF.tfidf(_docs(spark)).collect()}
    # stop words and 1-char tokens are dropped, Unicode letters and '_' are word characters
    assert {t for d, t in w if d == 1} == {"heart", "failure", "été", "café_2"}
    assert 3 not in {d for d, _ in w}
    n = 3
    assert w[(1, "heart")].idf == pytest.approx(math.log((1 + n) / (1 + 2)) + 1)
    assert sum(r.weight ** 2 for (d, _), r in w.items() if d == 1) == pytest.approx(1.0)


def test_fused_top_terms_equal_window_path(spark):
    a = sorted(tuple(r) for r in TF.top_terms(TF.tfidf(_docs(spark)), 2).collect())
    b = sorted(tuple(r) for r in TF.top_terms_per_doc(_docs(spark), 2).collect())
    assert a == b and len(a) == 4


def test_raw_text_is_not_shuffled(spark):
    counts = TF.term_counts(_docs(spark))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    exchanges = [ln for ln in plan.splitlines() if "Exchange" in ln]
    assert len(exchanges) == 1 and "text" not in exchanges[0] and "partial_count" in plan


def test_two_classes_are_fitted_as_two(spark):
    rows = [(i, ("fever cough ache " if i % 2 else "chest heart pulse ") * (1 + i % 3), "AB"[i % 2])
            for i in range(60)]
    found = TF.fit_baseline(spark.createDataFrame(rows, "doc_id long, text string, label string"))
    assert found.classes == [1] and found.n_train == 44 and found.n_features == 6
    assert found.gradient_norms.max() < 1e-6
    rep = {r.metric: r.value for r in TF.baseline_report(found.predictions, found.n_features, found.n_train).collect()}
    assert rep["accuracy"] == 1.0 and rep["f1[A]"] == 1.0 and rep["support[A]"] + rep["support[B]"] == 16


def test_sparse_rows_are_the_weights_of_m1(spark):
    docs = _docs(spark).withColumn("split", F.lit("train"))
    rows, n = TF.sparse_rows(docs, "doc_id", "text")
    assert n == 6
    want = {}
    for r in TF.tfidf(_docs(spark)).collect():
        want.setdefault(r.doc_id, []).append(r.weight)
    got = {r.doc_id: list(r.vals) for r in rows.collect()}
    assert got.keys() == {1, 2, 3} and got[3] == []
    for d, w in want.items():
        assert sorted(got[d]) == pytest.approx(sorted(w))


def test_baseline_of_odd_tables(spark):
    schema = "doc_id long, text string, label string, split string, cols string"
    rows = [(i, None if i % 7 == 0 else "" if i % 5 == 0 else f"w{i % 3} and more", None if i == 3 else "abc"[i % 3],
             "x", "y") for i in range(40)]
    found = TF.fit_baseline(spark.createDataFrame(rows, schema))
    assert found.labels == ["a", "b", "c"] and found.predictions.count() + found.n_train == 39
    empty = TF.fit_baseline(spark.createDataFrame([], schema))
    assert empty.predictions.count() == 0 and empty.n_train == 0
    one = TF.fit_baseline(spark.createDataFrame([(i, "x y", "only", "", "") for i in range(8)], schema))
    assert {r.predicted_diagnosis for r in one.predictions.collect()} == {"only"}


def test_encode_labels_sorted_classes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "a"), (5, None)], "id long, label string")
    got = {r.id: r.label_index for r in TF.encode_labels(df).collect()}
    assert got == {1: 1, 2: 0, 3: 2, 4: 0, 5: None}


def test_texts_dealt_by_id_are_the_only_exchange(spark):
    """Counts and lists per document are grouped where the text lies."""
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (1, "beta"), (None, "gamma gamma")], "doc_id long, text string")
    lists = TF.term_counts(docs, partitions=4).groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("t"))
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") == 1
    assert {r.doc_id: sorted((x.term, x.tf) for x in r.t) for r in lists.collect()} == \
        {1: [("alpha", 2), ("beta", 2)], None: [("gamma", 2)]}
