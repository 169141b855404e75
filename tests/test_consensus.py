"""Voting (T7–T9, W3, T11) — the reference's demo answers and tie rules."""
import pytest

from casebook.operators import consensus as C

DEMO = [  # the reference's demo answers
    (1, "Cardiology-Phi2", "STEMI", 0.85, 1),
    (1, "Metabolic-Phi2", "Non-STEMI", 0.30, 2),
    (1, "General-Phi2", "STEMI", 0.60, 3),
    (1, "GPT-3.5-Refine", "STEMI", 0.78, 4),
]
SCHEMA = "case_id long, agent_id string, diagnosis string, confidence double, answer_seq int"


def _answers(spark, data=DEMO):
    return spark.createDataFrame(data, SCHEMA)


def test_majority_demo(spark):
    t = {r.diagnosis: r.majority_score for r in C.score_table(_answers(spark)).collect()}
    assert t == {"STEMI": pytest.approx(0.75), "Non-STEMI": pytest.approx(0.25)}
    best = C.vote(_answers(spark), "majority").collect()[0]
    assert best.diagnosis == "STEMI"


def test_softmax_demo(spark):
    t = {r.diagnosis: r.softmax_score for r in C.score_table(_answers(spark)).collect()}
    assert t["STEMI"] == pytest.approx(0.609053, abs=1e-6)
    assert t["Non-STEMI"] == pytest.approx(0.390947, abs=1e-6)
    assert sum(t.values()) == pytest.approx(1.0)


def test_temperature_must_be_positive(spark):
    with pytest.raises(ValueError):
        C.vote(_answers(spark), "softmax", temp=0)


def test_confidence_is_clamped(spark):
    data = [(1, "a", "X", 1.7, 1), (1, "b", "Y", -0.4, 2)]
    t = {r.diagnosis: r.avg_confidence for r in C.score_table(_answers(spark, data)).collect()}
    assert t == {"X": 1.0, "Y": 0.0}


def test_ties_broken_by_median_then_first_seen(spark):
    # equal vote share; X has the higher median confidence
    data = [(1, "a", "Y", 0.9, 1), (1, "b", "Y", 0.1, 2), (1, "c", "X", 0.6, 3), (1, "d", "X", 0.5, 4)]
    assert C.vote(_answers(spark, data), "majority").collect()[0].diagnosis == "X"
    # full tie -> the diagnosis seen first wins
    data = [(1, "a", "Q", 0.5, 2), (1, "b", "P", 0.5, 1)]
    assert C.vote(_answers(spark, data), "majority").collect()[0].diagnosis == "P"


def test_cases_without_answers_are_absent(spark):
    data = [(1, "a", "X", 0.5, 1), (2, "a", "Y", 0.5, 1)]
    out = C.vote(_answers(spark, data)).collect()
    assert sorted(r.case_id for r in out) == [1, 2]


def test_case_pipeline_with_refined_row(spark):
    routed = _answers(spark, [(7, "cardio", "STEMI", 0.8, 1), (7, "gi", "GERD", 0.9, 2)])
    refined = _answers(spark, [(7, "refine", "STEMI", 0.7, 3)])
    r = C.case_pipeline(routed, refined).collect()[0]
    # two STEMI votes win the majority; softmax ranks mean confidence (GERD 0.9 > STEMI 0.75)
    assert r.majority_diagnosis == "STEMI" and r.softmax_diagnosis == "GERD"


def test_score_map(spark):
    m = C.score_map(C.scores(C.pool(_answers(spark)), "majority")).collect()[0].scores
    assert m == {"STEMI": 0.75, "Non-STEMI": 0.25}
