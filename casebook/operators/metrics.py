"""Scoring (A12–A22, A26, A27, F8, F12, L3, X14, X19) over a predictions table.

Input schema (``casebook.sources.views.predictions``): sample_id, true_diagnosis,
predicted_diagnosis, confidence, agent_used.  Everything is a grouped aggregate over that
table; label universes, bins and thresholds are tiny frames joined back by broadcast
(their size is bounded by the label list / bin count, not by the data).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.columns import first_nonempty, to_double_or_zero
from casebook.operators.ordering import global_index

# The calibration edges of the reference are numpy.linspace(0, 1, 11),
# written out exactly as that call produces them (0.3, 0.6 and 0.7 are not the decimals).
FIXED_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001,
               0.7000000000000001, 0.8, 0.9, 1.0]
N_BINS = 10
MIN_ROWS_ADAPTIVE = 10     # adaptive calibration needs more than this many rows


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# ---------------------------------------------------------------- F8 / F12 / X14 / X19 / L3

def prefix_filter(df: DataFrame, prefix: str, code_cols=("diagnosis_code", "label")) -> DataFrame:
    """Rows whose true code starts with ``prefix``; code = first non-empty of ``code_cols`` (F8)."""
    cols = [c for c in code_cols if c in df.columns]
    code = first_nonempty(*[_s(c) for c in cols])
    return df.where(code.isNotNull() & code.startswith(prefix))


def with_skip_reason(df: DataFrame, truth: str = "true_diagnosis", pred: str = "predicted_diagnosis",
                     patient: str | None = None) -> DataFrame:
    """Adds ``skip_reason``: missing_patient (null patient data, where ``patient`` names its
    column) / missing_truth / missing_prediction / null when usable (F12)."""
    t, p = F.nullif(_s(truth), F.lit("")), F.nullif(_s(pred), F.lit(""))
    no_patient = F.col(patient).isNull() if patient else F.lit(False)
    return df.withColumn("skip_reason", F.when(no_patient, "missing_patient")
                         .when(t.isNull(), "missing_truth").when(p.isNull(), "missing_prediction"))


def usable_rows(df: DataFrame, truth: str = "true_diagnosis",
                pred: str = "predicted_diagnosis", order_col: str = "sample_id") -> DataFrame:
    """sample_id, true/predicted (as strings), confidence, agent_used, correct — the rows an
    evaluation keeps (F12, X14).  A plain filter + projection: no shuffle."""
    rows = with_skip_reason(df, truth, pred).where(F.col("skip_reason").isNull())
    return rows.select(order_col, _s(truth).alias("true_diagnosis"),
                       _s(pred).alias("predicted_diagnosis"), "confidence", "agent_used",
                       (_s(truth) == _s(pred)).alias("correct"))


def processed_rows(df: DataFrame, truth: str = "true_diagnosis",
                   pred: str = "predicted_diagnosis", order_col: str = "sample_id",
                   limit: int | None = None) -> DataFrame:
    """``usable_rows`` plus sample_index: the running index of stored rows in ``order_col``
    order (X19); ``limit`` keeps the first N stored rows (L3)."""
    rows = usable_rows(df, truth, pred, order_col)
    if limit is not None and limit > 0:
        rows = rows.orderBy(order_col).limit(limit)
    return global_index(rows, order_col, "sample_index")


def run_summary(df: DataFrame, truth: str = "true_diagnosis", pred: str = "predicted_diagnosis",
                patient: str | None = None, seconds: str | None = None) -> DataFrame:
    """total, processed, skipped, skipped_missing_truth, _prediction and _patient, total_seconds
    and mean_seconds of the processed rows (A26; 0 when there are none or no ``seconds``)."""
    r = with_skip_reason(df, truth, pred, patient)
    spent = F.when(F.col("skip_reason").isNull(), F.col(seconds).cast("double") if seconds else F.lit(0.0))
    return r.agg(F.count(F.lit(1)).alias("total"),
                 F.count(F.when(F.col("skip_reason").isNull(), 1)).alias("processed"),
                 F.count("skip_reason").alias("skipped"),
                 F.count(F.when(F.col("skip_reason") == "missing_truth", 1))
                 .alias("skipped_missing_truth"),
                 F.count(F.when(F.col("skip_reason") == "missing_prediction", 1))
                 .alias("skipped_missing_prediction"),
                 F.count(F.when(F.col("skip_reason") == "missing_patient", 1))
                 .alias("skipped_missing_patient"),
                 F.round(F.coalesce(F.sum(spent), F.lit(0.0)), 6).alias("total_seconds"),
                 F.round(F.coalesce(F.avg(spent), F.lit(0.0)), 6).alias("mean_seconds"))


# ---------------------------------------------------------------- A12 / A13

def accuracy(records: DataFrame, truth: str = "ground_truth",
             pred: str = "predicted_diagnosis") -> DataFrame:
    """n_with_truth, n_correct, accuracy.

    Rows with a null truth are ignored; an empty-string truth counts in the denominator but
    is never correct.  No rows with truth -> accuracy 0.0.
    """
    has_t = F.col(truth).isNotNull()
    correct = has_t & (F.col(truth) != "") & (F.col(truth) == F.col(pred))
    a = records.agg(F.count(F.when(has_t, 1)).alias("n_with_truth"),
                    F.count(F.when(correct, 1)).alias("n_correct"))
    return a.select("n_with_truth", "n_correct",
                    F.round(F.coalesce(F.try_divide(F.col("n_correct").cast("double"),
                                                    F.col("n_with_truth")), F.lit(0.0)), 6)
                    .alias("accuracy"))


def _ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _f1(p, r) -> Column:
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def prf_for(records: DataFrame, condition: str, truth: str = "ground_truth",
            pred: str = "predicted_diagnosis") -> DataFrame:
    """condition, precision, recall, f1 for one class over rows with truth."""
    r = records.where(F.col(truth).isNotNull())
    is_p = F.col(pred).eqNullSafe(F.lit(condition))
    is_t = F.col(truth) == condition
    a = r.agg(F.count(F.when(is_p & is_t, 1)).alias("tp"),
              F.count(F.when(is_p & ~is_t, 1)).alias("fp"),
              F.count(F.when(~is_p & is_t, 1)).alias("fn"))
    p = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rc = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.select(F.lit(condition).alias("condition"), F.round(p, 6).alias("precision"),
                    F.round(rc, 6).alias("recall"), F.round(_f1(p, rc), 6).alias("f1"))


# ---------------------------------------------------------------- A14

def per_class(rows: DataFrame, truth: str = "true_diagnosis",
              pred: str = "predicted_diagnosis") -> DataFrame:
    """label, tp, n_true, n_pred over the union of true and predicted labels.

    Equal (truth, prediction) pairs are counted first; each pair then contributes once as its
    true label and once as its predicted label.
    """
    pairs = rows.groupBy(F.col(truth).alias("_t"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    zero, n = F.lit(0).cast("long"), F.col("_n")
    hit = F.when(F.col("_t") == F.col("_p"), n).otherwise(zero)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("_t").alias("label"), n.alias("t"), zero.alias("p"), hit.alias("h")),
        F.struct(F.col("_p").alias("label"), zero.alias("t"), n.alias("p"), zero.alias("h")))).alias("e"))
    return (both.where(F.col("e.label").isNotNull())
                .groupBy(F.col("e.label").alias("label"))
                .agg(F.sum("e.h").alias("tp"), F.sum("e.t").alias("n_true"),
                     F.sum("e.p").alias("n_pred"))
                .select("label", *[F.col(c).cast("long").alias(c) for c in ("tp", "n_true", "n_pred")]))


def class_report(rows: DataFrame, truth: str = "true_diagnosis",
                 pred: str = "predicted_diagnosis") -> DataFrame:
    """label, precision, recall, f1, support + 'macro avg' / 'weighted avg' rows.

    sklearn ``classification_report`` with zero_division=0: predicted-only labels score 0
    and count in the macro average; the weighted average weights by support.
    """
    pc = per_class(rows, truth, pred)
    p = _ratio(F.col("tp"), F.col("n_pred"))
    r = _ratio(F.col("tp"), F.col("n_true"))
    cls = pc.select("label", p.alias("precision"), r.alias("recall"),
                    _f1(p, r).alias("f1"), F.col("n_true").alias("support"))
    # every class counts for itself, in the macro average with weight 1 and in the weighted one
    # with its support: one aggregation, no branches
    one = F.lit(1.0)
    roles = F.array(*[F.struct(F.lit(i).alias("role"), name.alias("name"), weight.alias("w")) for i, (name, weight) in
                      enumerate(((F.col("label"), one), (F.lit("macro avg"), one),
                                 (F.lit("weighted avg"), F.col("support").cast("double"))))])
    parts = cls.select("precision", "recall", "f1", "support", F.inline(roles))
    out = parts.groupBy("role", "name").agg(
        *[_ratio(F.sum(F.col(c) * F.col("w")), F.sum("w")).alias(c) for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"))
    return out.select(F.col("name").alias("label"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                      F.coalesce(F.col("support"), F.lit(0)).cast("long").alias("support"))


def overall_scores(rows: DataFrame, truth: str = "true_diagnosis",
                   pred: str = "predicted_diagnosis") -> DataFrame:
    """accuracy, precision/recall/f1 weighted, f1 macro, n (evaluation summary)."""
    weighted, macro = F.col("label") == "weighted avg", F.col("label") == "macro avg"
    rep = class_report(rows, truth, pred).agg(
        *[F.max(F.when(weighted, F.col(c))).alias(f"{c}_weighted") for c in ("precision", "recall", "f1")],
        F.max(F.when(macro, F.col("f1"))).alias("f1_macro"))
    acc = rows.agg(F.count(F.lit(1)).alias("n"),
                   F.count(F.when(F.col(truth) == F.col(pred), 1)).alias("c"))
    both = acc.unionByName(rep, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return both.select(F.col("n").cast("long").alias("n"),
                       F.round(_ratio(F.col("c"), F.col("n")), 6).alias("accuracy"),
                       "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro")


# ---------------------------------------------------------------- A15

#: Labels of a dense matrix at most: their squares are rows of the result, their names the driver's.
DENSE_LABELS = 1000


def confusion_matrix(rows: DataFrame, labels: DataFrame | None = None, truth: str = "true_diagnosis",
                     pred: str = "predicted_diagnosis", dense: bool = False) -> DataFrame:
    """actual, predicted, n: every pair that occurs, over ``labels`` (a one-column frame ``label``)
    or, without it, over all labels.  ``dense`` adds a zero row for each pair that does not
    occur; it is for a given list of at most ``DENSE_LABELS`` labels (a report).

    Rows whose truth or prediction is null or outside the list are dropped.  Pairs are counted
    before the list is joined, so a common pair is one row in the joins.
    """
    if dense and labels is None:
        raise ValueError("a dense matrix needs its list of labels")
    counts = (rows.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
                  .groupBy(F.col(truth).cast("string").alias("actual"), F.col(pred).cast("string").alias("predicted"))
                  .agg(F.count(F.lit(1)).alias("n")))
    if labels is not None:
        lab = labels.select(F.col("label").cast("string").alias("label")).distinct()
        for side in ("actual", "predicted"):
            counts = counts.join(lab.withColumnRenamed("label", side), side, "left_semi")
    if dense:
        few = [r["label"] for r in lab.limit(DENSE_LABELS + 1).collect()]
        if len(few) > DENSE_LABELS:
            raise ValueError(f"more than {DENSE_LABELS} labels for a dense matrix")
        names = F.array(*[F.lit(x) for x in few]) if few else F.array().cast("array<string>")
        zeros = (rows.sparkSession.range(1).select(F.explode(names).alias("actual"))
                 .select("actual", F.explode(names).alias("predicted"), F.lit(0).alias("n")))
        counts = counts.unionByName(zeros).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))
    return counts.select("actual", "predicted", F.col("n").cast("long").alias("n"))


def labels_seen(rows: DataFrame, *columns: str) -> DataFrame:
    """label — the distinct non-null values of the columns."""
    each = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("label"))
    return each.where("label IS NOT NULL").distinct()


def top_labels(rows: DataFrame, col: str = "true_diagnosis", k: int = 10) -> DataFrame:
    """label — the k most frequent values of ``col`` (ties by value)."""
    return (rows.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("label")).limit(k).select("label"))


# ---------------------------------------------------------------- A16

def latency_stats(lat: DataFrame, op_col: str = "operation", value_col: str = "duration_ms",
                  exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """operation (null = all), is_overall, avg_ms, min_ms, max_ms, p95_ms, count.

    One ``rollup`` = GROUPING SETS ((operation), ()).  The exact p95 (numpy-style
    interpolation) comes from ``quantiles.exact_quantiles``, for the operations and for the
    total from the same counts.  ``exact=False`` uses a sketch.
    """
    from casebook.operators.quantiles import exact_quantiles
    x = F.col(value_col).cast("double")
    aggs = [F.avg(x).alias("avg_ms"), F.min(x).alias("min_ms"), F.max(x).alias("max_ms"),
            F.count(x).alias("count"), F.grouping_id().alias("gid")]
    if not exact:
        aggs.append(F.percentile_approx(x, 0.95, accuracy).alias("p95_ms"))
    g = lat.rollup(op_col).agg(*aggs).withColumn("is_overall", F.col("gid") == 1)
    if exact:
        p = exact_quantiles(lat, [op_col], value_col, [0.95], ["p95_ms"], total=True).select(
            "is_total", F.col(op_col).alias("_op"), "p95_ms")
        g = g.join(p, (g["is_overall"] == p["is_total"]) & g[op_col].eqNullSafe(p["_op"]),
                   "left").drop("_op", "is_total")
    return g.select(F.col(op_col).alias("operation"), "is_overall",
                    *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
                      for c in ("avg_ms", "min_ms", "max_ms", "p95_ms")],
                    F.col("count").cast("long").alias("count"))


# ---------------------------------------------------------------- A17 / A18

def agent_usage(rows: DataFrame, agent: str = "agent_used") -> DataFrame:
    return rows.groupBy(agent).agg(F.count(F.lit(1)).alias("n"))


def agent_accuracy(rows: DataFrame, agent: str = "agent_used") -> DataFrame:
    """agent, n_correct, n, accuracy."""
    return rows.groupBy(agent).agg(
        F.count(F.when(F.col("correct"), 1)).alias("n_correct"), F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


# ---------------------------------------------------------------- A19 / A20 / A21

def _bin_totals(binned: DataFrame, bins: DataFrame) -> DataFrame:
    agg = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"),
                                    F.avg(F.col("correct").cast("double")).alias("acc"))
    return bins.join(F.broadcast(agg), "bin", "left")   # agg has one row per bin


def calibration_fixed(rows: DataFrame, conf: str = "confidence") -> DataFrame:
    """bin, bin_center, n, accuracy over the 10 fixed edges; empty bins give 0 / 0.

    Bin = (number of edges <= confidence) - 1, like ``numpy.digitize``; confidence 1.0,
    values outside [0, 1] and NaN fall in no bin and are dropped.
    """
    x = F.col(conf).cast("double")
    le = sum((F.when(x >= F.lit(e), 1).otherwise(0) for e in FIXED_EDGES), F.lit(0)) - 1
    binned = (rows.select(le.alias("bin"), "correct")
              .where((F.col("bin") >= 0) & (F.col("bin") < N_BINS) & ~F.isnan(x)))
    spark = rows.sparkSession
    bins = spark.createDataFrame(
        [(i, (FIXED_EDGES[i] + FIXED_EDGES[i + 1]) / 2) for i in range(N_BINS)],
        "bin int, bin_center double")
    t = _bin_totals(binned, bins)
    return t.select("bin", F.round("bin_center", 6).alias("bin_center"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n"),
                    F.round(F.coalesce("acc", F.lit(0.0)), 6).alias("accuracy"))


def calibration_adaptive(rows: DataFrame, conf: str = "confidence") -> DataFrame:
    """bin, bin_center, n, accuracy — 10 bins over [min, max] of the confidences.

    Non-numeric confidence counts as 0.0; min = max widens the range by ±0.05; bins are
    clipped to 0..9 and only non-empty ones are returned; fewer than 11 rows -> no rows.
    """
    x = to_double_or_zero(F.col(conf).cast("string"))
    vals = rows.select(x.alias("x"), "correct")
    st = vals.agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count(F.lit(1)).alias("cnt"))
    lo = st.select(F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.05)
                   .otherwise(F.col("mn"))).scalar()
    hi = st.select(F.when(F.col("mn") == F.col("mx"), F.col("mn") + 0.05)
                   .otherwise(F.col("mx"))).scalar()
    enough = st.select(F.col("cnt") > MIN_ROWS_ADAPTIVE).scalar()
    step = (hi - lo) / F.lit(N_BINS)

    def edge(i):  # numpy.linspace: i * step + lo, last edge exactly hi
        return hi if i == N_BINS else F.lit(i) * step + lo

    idx = sum((F.when(F.col("x") >= edge(i), 1).otherwise(0) for i in range(1, N_BINS)), F.lit(0))
    agg = (vals.where(enough).select(idx.alias("bin"), "correct")
           .groupBy("bin").agg(F.count(F.lit(1)).alias("n"),
                               F.avg(F.col("correct").cast("double")).alias("acc")))
    center = F.element_at(F.array(*[(edge(i) + edge(i + 1)) / 2 for i in range(N_BINS)]),
                          F.col("bin") + 1)
    return agg.select("bin", F.round(center, 6).alias("bin_center"),
                      F.col("n").cast("long").alias("n"), F.round("acc", 6).alias("accuracy"))


def confidence_histogram(rows: DataFrame, conf: str = "confidence", bins: int = N_BINS) -> DataFrame:
    """correct, bin, bin_lo, bin_hi, n — one shared range, split by correctness."""
    from casebook.operators.explore import binned_counts
    x = to_double_or_zero(F.col(conf).cast("string"))
    vals = rows.select(x.alias("x"), "correct")
    return binned_counts(vals, bins, ("correct",), [(True,), (False,)])


# ---------------------------------------------------------------- S19 / A27

def diagnosis_records(preds: DataFrame, ts_col: str | None = None,
                      model_name: str = "") -> DataFrame:
    """Diagnosis log records: correct is null when the truth is null or empty."""
    t = F.col("true_diagnosis")
    return preds.select(
        (F.col(ts_col) if ts_col else F.lit(None).cast("timestamp")).alias("timestamp"),
        F.col("sample_id").cast("string").alias("patient_id"), F.lit(model_name).alias("model_name"),
        F.col("predicted_diagnosis"), t.alias("ground_truth"), F.col("confidence"),
        F.when(t.isNull() | (t == ""), F.lit(None).cast("boolean"))
         .otherwise(t.eqNullSafe(F.col("predicted_diagnosis"))).alias("correct"))


def metrics_report(records: DataFrame, latencies: DataFrame, conditions: DataFrame | None = None,
                   dense: bool = False) -> DataFrame:
    """section, name, metric, value — the full report in long form.

    overall accuracy and latency, latency per operation and, when ``conditions`` (a frame
    of labels) is given, P/R/F1 per condition and the confusion counts.
    """
    acc = accuracy(records).select(F.lit("overall").alias("section"), F.lit("").alias("name"),
                                   F.lit("accuracy").alias("metric"),
                                   F.col("accuracy").alias("value"))
    tot = records.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("overall").alias("section"), F.lit("").alias("name"),
        F.lit("total_diagnoses").alias("metric"), "value")
    lat = latency_stats(latencies)
    lat_long = lat.select(
        F.when(F.col("is_overall"), "latency").otherwise("operation").alias("section"),
        F.coalesce(F.col("operation"), F.lit("")).alias("name"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                            for m in ("avg_ms", "min_ms", "max_ms", "p95_ms", "count")])).alias("kv")
    ).select("section", "name", "kv.metric", "kv.value")
    out = acc.unionByName(tot).unionByName(lat_long)
    if conditions is not None:
        rec = records.where(F.col("ground_truth").isNotNull())
        labs = conditions.select(F.col("label").cast("string").alias("label")).distinct()
        # fp = n_pred - tp and fn = n_true - tp: per-label aggregates, no pairing of rows
        # with labels.
        pc = labs.join(per_class(rec, "ground_truth", "predicted_diagnosis"), "label", "left") \
            .na.fill(0, ["tp", "n_true", "n_pred"])
        p = _ratio(F.col("tp"), F.col("n_pred"))
        r = _ratio(F.col("tp"), F.col("n_true"))
        prf = pc.select(F.lit("condition").alias("section"), F.col("label").alias("name"),
                        F.explode(F.array(
                            F.struct(F.lit("precision").alias("metric"), p.alias("value")),
                            F.struct(F.lit("recall").alias("metric"), r.alias("value")),
                            F.struct(F.lit("f1").alias("metric"), _f1(p, r).alias("value"))))
                        .alias("kv")).select("section", "name", "kv.metric", "kv.value")
        cm = confusion_matrix(rec, conditions, "ground_truth", "predicted_diagnosis", dense).select(
            F.lit("confusion").alias("section"),
            F.concat_ws(" -> ", "actual", "predicted").alias("name"),
            F.lit("count").alias("metric"), F.col("n").cast("double").alias("value"))
        out = out.unionByName(prf).unionByName(cm)
    return out.select("section", "name", "metric", F.round("value", 6).alias("value"))
