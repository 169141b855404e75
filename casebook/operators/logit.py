"""One-vs-rest logistic regression by trust-region Newton steps (M2).

Per class the model minimises  1/2 |w|^2 + C sum_i log(1 + exp(-s_i w.x_i)),  s_i = 1 for rows of
the class and -1 for the others, with the intercept as one more, penalised weight - the
problem a liblinear-style solver poses.  It is strictly convex, so the optimum is unique and a
result can be checked by its gradient alone.

All problems advance side by side.  A trust-region Newton search asks either for value and
gradient at some weights or for a Hessian-vector product (conjugate gradients inside the step);
one Spark pass over the staged sparse rows answers the open question of every class at once.
The rows are packed once: some thousand of them lie in one row as plain arrays, which a pass reads
without taking lists apart value by value.
A task returns its partial sums as one row, rows are added in two levels (about the square
root of the number of tasks meet in a task, then on the driver), so neither a task nor the driver
ever holds more than that many models.  At most ``MODELS_AT_ONCE`` classes share a pass.

Rows: ``y`` (class number), ``cols`` and ``vals`` (sparse features).  Rows without features
count with their intercept alone.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casebook.plans.stage import materialise
from casebook.session import reach_workers

#: Norm of the gradient at which a search ends, and its limits.
TOLERANCE, NEWTON_STEPS, CG_STEPS = 1e-7, 60, 200
MODELS_AT_ONCE = 64
#: Values (and rows) of one packed block at most, unless one row alone has more.
BLOCK_VALUES = 1 << 17
PARTS = {"y": np.int32, "size": np.int32, "cols": np.int32, "vals": np.float64}


def search(width: int, c: float, tolerance: float = TOLERANCE) -> Generator:
    """Trust-region Newton search.  Yields (weights, None) for value and gradient of the loss sum,
    or (weights, direction) for its Hessian times the direction; returns (weights, gradient norm)."""
    w = np.zeros(width)
    loss, slope = yield w, None
    value, g = c * loss, c * slope
    radius = np.linalg.norm(g)
    for _ in range(NEWTON_STEPS):
        norm = np.linalg.norm(g)
        if norm <= tolerance:
            break
        step, rest = np.zeros(width), -g
        way, square = rest.copy(), float(rest @ rest)
        for _ in range(CG_STEPS):
            if np.sqrt(square) <= min(0.1, np.sqrt(norm)) * norm:
                break
            bent = way + c * (yield w, way)
            size = square / float(way @ bent)
            if np.linalg.norm(step + size * way) > radius:
                # to the border of the trust region
                a, b = float(way @ way), float(step @ way)
                size = (-b + np.sqrt(b * b + a * (radius ** 2 - float(step @ step)))) / a
                step, rest = step + size * way, rest - size * bent
                break
            step, rest = step + size * way, rest - size * bent
            square, before = float(rest @ rest), square
            way = rest + square / before * way
        loss, slope = yield w + step, None
        new = 0.5 * float((w + step) @ (w + step)) + c * loss
        expected = -0.5 * (float(g @ step) - float(step @ rest))
        fresh = w + step + c * slope
        # near the optimum a gain drowns in the rounding of the values: there the gradient decides
        told = expected > 1e-12 * max(1.0, abs(value))
        ratio = (value - new) / expected if told else float(np.linalg.norm(fresh) < norm)
        length = np.linalg.norm(step)
        if ratio < 0.25:
            radius = 0.5 * min(radius, length)
        elif ratio > 0.75:
            radius = max(radius, 2 * length)
        if ratio > 1e-4:
            w, value, g = w + step, new, fresh
        elif not told:
            break                                    # no digits left to gain
    return w, float(np.linalg.norm(g))


def _answers(y, row, cols, vals, n, asked: dict, width: int) -> np.ndarray:
    """Per question one line: the loss, then the gradient (or Hessian product); intercept last."""
    out = np.zeros((len(asked), width + 1))
    for line, (k, (w, direction)) in zip(out, sorted(asked.items())):
        s = np.where(y == k, 1.0, -1.0)
        z = np.bincount(row, weights=vals * w[cols], minlength=n) + w[-1]
        p = 1 / (1 + np.exp(np.clip(s * z, -700, 700)))          # 1 - sigmoid(s z)
        if direction is None:
            line[0] = np.logaddexp(0, -s * z).sum()
            weight = -s * p
        else:
            along = np.bincount(row, weights=vals * direction[cols], minlength=n) + direction[-1]
            weight = p * (1 - p) * along
        line[1:-1] = np.bincount(cols, weights=vals * weight[row], minlength=width - 1)
        line[-1] = weight.sum()
    return out


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` (y, cols, vals) in blocks of at most ``BLOCK_VALUES`` values: one binary column per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("cols").value_lengths().to_numpy(zero_copy_only=False)
            block = np.cumsum(np.maximum(size, 1)) // BLOCK_VALUES
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
            for at, after in zip(cuts, cuts[1:]):
                part = batch.slice(at, after - at)
                found = {"y": part.column("y"), "size": part.column("cols").value_lengths(),
                         "cols": part.column("cols").flatten(), "vals": part.column("vals").flatten()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([found[n].to_numpy(zero_copy_only=False).astype(t).tobytes()], pa.binary())
                     for n, t in PARTS.items()], names=list(PARTS))

    return rows.select("y", "cols", "vals").mapInArrow(run, ", ".join(f"{n} binary" for n in PARTS))


def _pass(blocks: DataFrame, asked: dict, width: int) -> dict:
    """Answers to all questions {class: (weights, direction or None)} from one pass over the blocks."""
    shape = (len(asked), width + 1)
    fan = max(1, int(np.sqrt(blocks.rdd.getNumPartitions())))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros(shape)
        for batch in batches:
            for block in zip(*(batch.column(n) for n in PARTS)):
                y, size, cols, vals = (np.frombuffer(x.as_buffer(), dtype=t) for x, t in zip(block, PARTS.values()))
                total += _answers(y, np.repeat(np.arange(len(y)), size), cols, vals, len(y), asked, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() % fan], pa.int32()), pa.array([total.tobytes()], pa.binary())],
            names=["slot", "total"])

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(shape)
        for raw in table.column("total"):
            total += np.frombuffer(raw.as_buffer(), dtype=np.float64).reshape(shape)
        return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

    sums = (blocks.mapInArrow(partial, "slot int, total binary").groupBy("slot")
            .applyInArrow(added, "total binary"))
    total = np.zeros(shape)
    for r in sums.toLocalIterator():
        total += np.frombuffer(r["total"], dtype=np.float64).reshape(shape)
    return {k: (line[0], line[1:]) if asked[k][1] is None else line[1:]
            for k, line in zip(sorted(asked), total)}


def fit(rows: DataFrame, classes: list[int], features: int, c: float = 1.0,
        tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """(weights, one line per class with the intercept last; gradient norms; passes).

    ``rows`` (y, cols, vals) is read once and packed; each pass reads the packed blocks."""
    reach_workers(rows.sparkSession)
    # dealt out evenly: a pass lasts as long as its largest task
    blocks = materialise(packed(rows).repartition(rows.sparkSession.sparkContext.defaultParallelism * 2))
    width, found, passes = features + 1, {}, 0
    for at in range(0, len(classes), MODELS_AT_ONCE):
        searches = {k: search(width, c, tolerance) for k in classes[at:at + MODELS_AT_ONCE]}
        asked = {k: next(s) for k, s in searches.items()}
        while asked:
            answers, passes = _pass(blocks, asked, width), passes + 1
            for k, answer in answers.items():
                try:
                    asked[k] = searches[k].send(answer)
                except StopIteration as end:
                    found[k] = end.value
                    del asked[k]
    return (np.array([found[k][0] for k in classes]).reshape(len(classes), width),
            np.array([found[k][1] for k in classes]), passes)


def predict(rows: DataFrame, weights: np.ndarray, classes: list[int], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``pred``: the class of the greatest margin (the first of equal ones); with
    one model, its class where the margin is positive and the class before it elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.column("cols")
            n, size = batch.num_rows, cols.value_lengths().to_numpy(zero_copy_only=False)
            row, at = np.repeat(np.arange(n), size), cols.flatten().to_numpy(zero_copy_only=False)
            vals = batch.column("vals").flatten().to_numpy(zero_copy_only=False)
            best, pred = np.zeros(n), np.full(n, classes[0] - 1 if len(classes) == 1 else classes[0], dtype=np.int32)
            for i, (k, w) in enumerate(zip(classes, weights)):
                z = np.bincount(row, weights=vals * w[at], minlength=n) + w[-1]
                better = z > best if i or len(classes) == 1 else np.ones(n, dtype=bool)
                best, pred = np.where(better, z, best), np.where(better, np.int32(k), pred)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(pred, pa.int32())],
                                             names=[*keep, "pred"])

    reach_workers(rows.sparkSession)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "cols", "vals").mapInArrow(run, f"{schema}, pred int")
