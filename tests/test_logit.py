"""One-vs-rest logistic regression against plain numpy."""
import numpy as np
import pytest

from casebook.operators import logit
from casebook.plans.stage import materialise


def problem(seed=1, n=300, features=25, classes=4):
    rng = np.random.default_rng(seed)
    x = rng.random((n, features)) * (rng.random((n, features)) < 0.2)
    x[:5] = 0                                             # rows without features
    y = (x @ rng.normal(size=(features, classes)) + rng.gumbel(size=(n, classes)) * 0.3).argmax(axis=1)
    return x, y


def frame(spark, x, y, parts=5):
    rows = [(i, int(k), np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, (r, k) in enumerate(zip(x, y))]
    return materialise(spark.createDataFrame(rows, "id long, y int, cols array<int>, vals array<double>")
                       .repartition(parts))


def gradient(w, x, s, c):
    z = s * (x @ w)
    return w - c * x.T @ (s / (1 + np.exp(z)))


@pytest.mark.parametrize("c", [0.3, 1.0, 50.0])
def test_gradient_vanishes_at_the_optimum(spark, c):
    x, y = problem()
    weights, norms, passes = logit.fit(frame(spark, x, y), [0, 1, 2, 3], x.shape[1], c)
    full = np.c_[x, np.ones(len(x))]
    for k, w in enumerate(weights):
        g = gradient(w, full, np.where(y == k, 1.0, -1.0), c)
        assert np.linalg.norm(g) < 1e-6 and norms[k] < 1e-6
    assert passes < 200


def test_one_pass_answers_for_all_classes(spark, monkeypatch):
    """The number of passes is that of the slowest class, not the sum."""
    x, y = problem()
    rows = frame(spark, x, y)
    alone = [logit.fit(rows, [k], x.shape[1])[2] for k in range(4)]
    weights, _, together = logit.fit(rows, [0, 1, 2, 3], x.shape[1])
    assert together == max(alone)
    monkeypatch.setattr(logit, "MODELS_AT_ONCE", 3)
    again, _, split = logit.fit(rows, [0, 1, 2, 3], x.shape[1])
    assert split == max(alone[:3]) + alone[3]
    np.testing.assert_allclose(again, weights, atol=1e-8)


def test_predictions_take_the_greatest_margin(spark):
    x, y = problem(seed=3)
    rows = frame(spark, x, y)
    weights, _, _ = logit.fit(rows, [0, 1, 2, 3], x.shape[1])
    got = {r.id: r.pred for r in logit.predict(rows, weights, [0, 1, 2, 3], ["id"]).collect()}
    full = np.c_[x, np.ones(len(x))]
    assert [got[i] for i in range(len(x))] == (full @ weights.T).argmax(axis=1).tolist()
    two = logit.predict(rows, weights[1:2], [1], ["id"])
    assert {r.id: r.pred for r in two.collect()} == dict(enumerate((full @ weights[1] > 0).astype(int).tolist()))


def test_search_without_rows_stays_at_zero():
    s = logit.search(3, 1.0)
    w, direction = next(s)
    assert direction is None
    with pytest.raises(StopIteration) as end:
        s.send((0.0, np.zeros(3)))
    assert end.value.value[0].tolist() == [0, 0, 0]


def test_rows_are_packed_once(spark, monkeypatch):
    """Passes read blocks of plain arrays: a few rows that hold every value, of bounded size."""
    monkeypatch.setattr(logit, "BLOCK_VALUES", 200)
    x, y = problem()
    blocks = logit.packed(frame(spark, x, y)).collect()
    assert 300 / 200 < len(blocks) < 60
    assert max(len(b.vals) // 8 for b in blocks) <= 200 + x.shape[1]
    got = sorted((int(k), int(n)) for b in blocks
                 for k, n in zip(np.frombuffer(b.y, np.int32), np.frombuffer(b["size"], np.int32)))
    assert got == sorted((int(k), int((r != 0).sum())) for k, r in zip(y, x))
    assert np.isclose(sum(np.frombuffer(b.vals).sum() for b in blocks), x.sum())
