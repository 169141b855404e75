"""The quality classifier's risk, gradient and class prior, recomputed in plain numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.llm import quality_pu as Q
from casebook.llm.common import fold, read, stage


def losses(model, x, positive, w):
    a = np.c_[np.clip((Q.with_shape(x) - model.mean) / model.sd, -Q.CLIP, Q.CLIP), np.ones(len(x))]
    z, p = a @ w, model.prior
    soft, sigmoid = np.logaddexp(0, z), 1 / (1 + np.exp(-z))
    kept = p * np.logaddexp(0, -z[positive]).mean()
    negative = soft.mean() - p * soft[positive].mean()
    slope_kept = -p * (a[positive] * (1 - sigmoid[positive])[:, None]).mean(axis=0)
    slope_negative = (a * sigmoid[:, None]).mean(axis=0) - p * (a[positive] * sigmoid[positive][:, None]).mean(axis=0)
    return kept, negative, slope_kept, slope_negative


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_weights_minimise_the_non_negative_risk(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    measures = stage(Q.measured(read(spark, sf_dir, "documents"), "doc_id"))
    labels = read(spark, sf_dir, "labels")
    trained = fold("doc_id", 4) != 2
    model = Q.fit(measures, labels, trained)
    good = {r[0] for r in labels.where(trained & (F.col("quality") == 1)).select("doc_id").collect()}
    rows = measures.where(trained).collect()
    x = np.array([r.x for r in rows], dtype=np.float32).astype(float)
    positive = np.array([r.doc_id in good for r in rows])
    ridge = np.full(x.shape[1] * 2 + 1, Q.RIDGE + Q.FEW / positive.sum())
    ridge[-1] = 0

    def objective(w):
        kept, negative, _, _ = losses(model, x, positive, w)
        return kept + max(0.0, negative) + 0.5 * (ridge * w * w).sum()

    w = model.weights
    kept, negative, slope_kept, slope_negative = losses(model, x, positive, w)
    assert negative > -Q.TOLERANCE and kept + max(0.0, negative) >= 0
    assert model.negative_risk == pytest.approx(negative, abs=1e-9)
    assert model.risk == pytest.approx(kept + max(0.0, negative), abs=1e-9)
    # a subgradient is zero: the slope of kept + v negative + ridge for some v between 0 and 1
    slope = slope_kept + ridge * w
    v = np.clip(-(slope @ slope_negative) / (slope_negative @ slope_negative), 0, 1)
    assert np.abs(slope + v * slope_negative).max() < 10 * Q.TOLERANCE
    assert v == pytest.approx(1, abs=1e-6) or abs(negative) < Q.TOLERANCE
    rng = np.random.default_rng(0)
    here = objective(w)
    for size in (1e-3, 1e-1, 1.0):
        for _ in range(100):
            assert objective(w + size * rng.normal(size=len(w)) / np.sqrt(len(w))) >= here - 2 * Q.TOLERANCE


def test_clipped_risk_is_reached_when_the_plain_one_turns_negative():
    """Few positives and many statistics: the unclipped risk has a minimum with negative risk below
    zero, the search ends on the border."""
    rng = np.random.default_rng(3)
    a = np.c_[rng.normal(size=(120, 30)), np.ones(120)]
    positive = np.arange(120) < 40
    ridge = np.r_[np.full(30, 1e-3), 0]
    prior = 0.9

    def parts_at(wanted):
        return {i: Q.Parts(Q.Parts.of(a, positive, w), 31) for i, w in wanted.items()}

    def plain(p):
        return (p.risks(prior)[1], p.unl_slope - prior * p.z_slope, p.unl_curve)

    _, parts = Q.drive([Q.newton(plain, ridge, np.zeros(31), 1e-8)], parts_at)[0]
    kept, whole = parts.risks(prior)
    assert whole - kept < 0
    w, parts, v = Q.drive([Q.non_negative(prior, ridge, np.zeros(31), 1e-8)], parts_at)[0]
    kept, whole = parts.risks(prior)
    assert abs(whole - kept) < 1e-6 and 0 < v < 1
    slope = v * prior * parts.pos_slope + (1 - v) * (parts.unl_slope - prior * parts.z_slope) + ridge * w
    assert np.abs(slope).max() < 1e-6


def test_prior_from_both_samples():
    rng = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.9):
        good, bad = rng.beta(6, 2, 40_000), rng.beta(1, 9, 20_000)
        mixed = np.r_[good[20_000:], bad[:int(20_000 / prior * (1 - prior))]][:40_000]
        bins = lambda s: np.bincount((s * Q.PRIOR_BINS).astype(int), minlength=Q.PRIOR_BINS)
        share = 20_000 / len(mixed)
        assert Q.prior_of(bins(good[:20_000]), bins(mixed)) == pytest.approx(share, abs=0.05)


def test_prior_of_the_labelled_documents(spark):
    """The estimate from positives and unlabelled texts against the labels it has not read."""
    sf_dir = "/root/testdata/sf0.01"
    labels = read(spark, sf_dir, "labels")
    model = Q.fit(stage(Q.measured(read(spark, sf_dir, "documents"), "doc_id")), labels, fold("doc_id", 4) != 2)
    share = labels.agg(F.avg("quality")).first()[0]
    assert model.prior == pytest.approx(share, abs=0.05)
