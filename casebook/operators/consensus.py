"""Voting over agent answers.

Input: case_id, agent_id, diagnosis, confidence, answer_seq (the input order, used for the
"first seen wins" final tie-break).  Answers are first reduced to one row per
(case, diagnosis) with map-side partial aggregation; each case then becomes one list of its
distinct diagnoses (bounded, however many answers the case has) in which the softmax
normaliser, vote shares and the arg-max are computed — no per-case window sort, and both
methods come from the same list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.columns import clamp01

ROUND_BEFORE_RANK = 9   # mean confidence is rounded before ranking so float order can't flip ties


def pool(answers: DataFrame) -> DataFrame:
    """case_id, diagnosis, n_votes, avg_confidence, median_confidence, first_seen."""
    a = answers.withColumn("confidence", clamp01("confidence"))
    return a.groupBy("case_id", "diagnosis").agg(
        F.count(F.lit(1)).alias("n_votes"),
        F.round(F.avg("confidence"), ROUND_BEFORE_RANK).alias("avg_confidence"),
        F.median("confidence").alias("median_confidence"),
        F.min("answer_seq").alias("first_seen"))


def _per_case(pooled: DataFrame) -> DataFrame:
    """case_id, d: the case's pooled diagnoses sorted by diagnosis (at most one entry per
    distinct diagnosis, so the list is bounded however many answers the case has)."""
    return pooled.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(
        "diagnosis", "n_votes", "avg_confidence", "median_confidence", "first_seen"))).alias("d"))


def _scored(d, method: str, temp: float):
    """The case's entries with ``score``: softmax of mean confidence / temp, or vote share."""
    if method == "softmax":
        logits = F.transform(d, lambda x: x["avg_confidence"] / F.lit(float(temp)))
        mx = F.array_max(logits)
        total = F.aggregate(logits, F.lit(0.0), lambda a, l: a + F.exp(l - mx))
        return F.transform(d, lambda x: x.withField(
            "score", F.exp(x["avg_confidence"] / F.lit(float(temp)) - mx) / total))
    if method == "majority":
        total = F.aggregate(d, F.lit(0).cast("long"), lambda a, x: a + x["n_votes"])
        return F.transform(d, lambda x: x.withField("score", x["n_votes"] / total))
    raise ValueError(f"unsupported aggregation method: {method}")


def scores(pooled: DataFrame, method: str = "softmax", temp: float = 1.0) -> DataFrame:
    """Pooled rows with ``score``: softmax of mean confidence / temp, or vote share."""
    if temp <= 0:
        raise ValueError("temperature must be > 0")
    per = _per_case(pooled)
    return per.select("case_id", F.explode(_scored(F.col("d"), method, temp)).alias("x")).select(
        "case_id", "x.*")


def _winner(scored):
    """Arg-max by score, then median confidence, then first seen, then diagnosis."""
    keyed = F.transform(scored, lambda x: F.struct(
        (-x["score"]).alias("k1"), (-x["median_confidence"]).alias("k2"),
        x["first_seen"].alias("k3"), x["diagnosis"].alias("k4"), x["score"].alias("score")))
    return F.element_at(F.array_sort(keyed), 1)


def winners(scored: DataFrame) -> DataFrame:
    """case_id, diagnosis, score — the arg-max row of each case of a scored frame."""
    per = scored.groupBy("case_id").agg(F.collect_list(F.struct(
        "diagnosis", "score", "median_confidence", "first_seen")).alias("s"))
    w = _winner(F.col("s"))
    return per.select("case_id", w["k4"].alias("diagnosis"), w["score"].alias("score"))


def vote(answers: DataFrame, method: str = "softmax", temp: float = 1.0) -> DataFrame:
    """Best diagnosis per case; cases without answers are absent."""
    if temp <= 0:
        raise ValueError("temperature must be > 0")
    w = _winner(_scored(F.col("d"), method, temp))
    return _per_case(pool(answers)).select("case_id", w["k4"].alias("diagnosis"),
                                           w["score"].alias("score"))


def score_table(answers: DataFrame, temp: float = 1.0) -> DataFrame:
    """case_id, diagnosis, n_votes, avg/median confidence, softmax_score, majority_score."""
    if temp <= 0:
        raise ValueError("temperature must be > 0")
    per = _per_case(pool(answers))
    both = F.arrays_zip(_scored(F.col("d"), "softmax", temp).alias("s"),
                        _scored(F.col("d"), "majority", temp).alias("m"))
    return per.select("case_id", F.explode(both).alias("z")).select(
        "case_id", "z.s.diagnosis", "z.s.n_votes", "z.s.avg_confidence", "z.s.median_confidence",
        "z.s.first_seen", F.col("z.s.score").alias("softmax_score"),
        F.col("z.m.score").alias("majority_score"))


def score_map(scored: DataFrame) -> DataFrame:
    """case_id, scores MAP<diagnosis, score> (the per-case dict of the reference)."""
    return scored.groupBy("case_id").agg(
        F.map_from_entries(F.collect_list(F.struct("diagnosis", "score"))).alias("scores"))


def case_pipeline(routed_answers: DataFrame, refined: DataFrame | None = None,
                  temp: float = 1.0) -> DataFrame:
    """case_id, softmax_diagnosis, softmax_score, majority_diagnosis, majority_score.

    ``routed_answers`` is the fan-out of routed specialists (T3); ``refined`` (optional)
    adds one refined answer per case before voting (U3).
    """
    cand = routed_answers.select("case_id", "agent_id", "diagnosis", "confidence", "answer_seq")
    if refined is not None:
        cand = cand.unionByName(refined.select("case_id", "agent_id", "diagnosis", "confidence",
                                               "answer_seq"))
    if temp <= 0:
        raise ValueError("temperature must be > 0")
    ws = _winner(_scored(F.col("d"), "softmax", temp))
    wm = _winner(_scored(F.col("d"), "majority", temp))
    # both methods from one per-case list: no second pass, no join
    return _per_case(pool(cand)).select(
        "case_id", ws["k4"].alias("softmax_diagnosis"), ws["score"].alias("softmax_score"),
        wm["k4"].alias("majority_diagnosis"), wm["score"].alias("majority_score"))
