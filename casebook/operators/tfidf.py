"""TF-IDF features as a relational plan (M1) and the logistic-regression baseline (M2, M3).

Tokenising follows the reference's vectoriser: lower-case, runs of two or more word
characters, English stop words removed, vocabulary = the ``max_features`` most frequent
terms, smooth idf ``ln((1 + n) / (1 + df)) + 1``, L2-normalised rows.  The stop-word list is
Spark ML's public English list (``StopWordsRemover``), pinned as configuration — it differs
from scikit-learn's list.

Plan: the raw text is never shuffled.  A document is one row, so its (doc, term) counts are
complete after the map-side partial aggregation and only those counts move.  They feed two
consumers (document frequencies and the weights), so each document's list of counts is written
once to the shared scratch folder.  Document frequencies are a term-level aggregate with map-side partial
aggregation; the vocabulary is a bounded top-k (``max_features`` rows, broadcast).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.functions.stopwords import ENGLISH
from casebook.plans.stage import materialise

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
MAX_FEATURES = 10000


def english_stop_words() -> tuple[str, ...]:
    """The pinned English stop-word list (plain data in the package)."""
    return tuple(ENGLISH)


NON_WORD = r"[^\p{L}\p{N}_]+"


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                partitions: int | None = None) -> DataFrame:
    """doc_id, term, tf — raw counts of non-stop-word tokens (whole texts).  ``partitions`` deals the
    documents out by id first, at least that many ways: for few large files whose row groups are
    fewer than the cores.  The texts are then all that moves: counts and lists per document, grouped
    by the same id, need no further exchange.

    Tokens are the maximal runs of word characters of length >= 2 (split on non-word runs,
    which gives the same tokens as extracting ``TOKEN_PATTERN`` and is cheaper).
    """
    if partitions:
        ways = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        docs = docs.select(id_col, text_col).repartition(max(partitions, ways), id_col)
    toks = docs.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), NON_WORD)).alias("term"))
    toks = toks.where((F.length("term") >= 2) & ~F.col("term").isin(*english_stop_words()))
    return toks.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               partitions: int | None = None) -> DataFrame:
    """doc_id and ``terms`` (array of term, tf): one row per document that has a term, written once
    for its two readers (document frequencies, and the weights that the vocabulary leaves)."""
    counts = term_counts(docs, id_col, text_col, partitions)
    return materialise(counts.groupBy(id_col).agg(F.collect_list(F.struct("term", "tf")).alias("terms")))


def vocabulary(lists: DataFrame, n_docs, max_features: int = MAX_FEATURES) -> DataFrame:
    """term, df, idf of the ``max_features`` commonest terms (ties by term)."""
    terms = (lists.select(F.inline("terms")).groupBy("term")
             .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf")))
    return (terms.orderBy(F.col("total_tf").desc(), F.col("term").asc()).limit(max_features)
            .select("term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf")))


def raw_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_features: int = MAX_FEATURES, partitions: int | None = None) -> DataFrame:
    """doc_id, term, tf, df, idf, raw (= tf·idf, before normalisation) over the vocabulary."""
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    lists = term_lists(docs, id_col, text_col, partitions)
    vocab = vocabulary(lists, n_docs, max_features)
    return (lists.select(id_col, F.inline("terms")).join(F.broadcast(vocab), "term")
            .withColumn("raw", F.col("tf") * F.col("idf")))


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_features: int = MAX_FEATURES) -> DataFrame:
    """doc_id, term, tf, df, idf, weight (L2-normalised tf·idf over the vocabulary)."""
    w = raw_weights(docs, id_col, text_col, max_features)
    # The norm is a window over the document (all weights are returned); the registered
    # top-k query uses ``top_terms_per_doc``, which folds norm and top-k into one aggregate.
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", "tf", "df", "idf", (F.col("raw") / norm).alias("weight"))


def top_terms_per_doc(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
                      max_features: int = MAX_FEATURES, partitions: int | None = None) -> DataFrame:
    """doc_id, rank, term, weight — each document's k heaviest normalised terms.

    One aggregation per document gives both the L2 norm and the document's (term, raw)
    list; weights and the top-k are computed inside that list.  A document's list is bounded
    by its own length, and no sort of all weights is needed (unlike a ranking window).
    """
    w = raw_weights(docs, id_col, text_col, max_features, partitions)
    per_doc = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"),
                                    F.collect_list(F.struct("term", "raw")).alias("items"))
    ranked = F.array_sort(F.transform(F.col("items"), lambda x: F.struct(
        (-F.round(x["raw"] / F.col("norm"), 9)).alias("key"), x["term"].alias("term"),
        (x["raw"] / F.col("norm")).alias("weight"))))
    return (per_doc.select(id_col, F.posexplode(F.slice(ranked, 1, k)).alias("pos", "t"))
                   .select(id_col, (F.col("pos") + 1).cast("long").alias("rank"), "t.term",
                           F.round("t.weight", 6).alias("weight")))


def top_terms(weights: DataFrame, k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """doc_id, rank, term, weight — each document's k heaviest terms (ties by term)."""
    win = Window.partitionBy(id_col).orderBy(F.round("weight", 9).desc(), F.col("term").asc())
    return (weights.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)
                   .select(id_col, F.col("rank").cast("long").alias("rank"), "term",
                           F.round("weight", 6).alias("weight")))


# ---------------------------------------------------------------- M2 / M3

def sparse_rows(split: DataFrame, id_col: str, text_col: str, max_features: int = MAX_FEATURES,
                fitted: str = "split = 'train'") -> tuple[DataFrame, int]:
    """(rows of ``split`` without the text, with ``cols`` and ``vals``; number of features).

    Vocabulary and idf come from the rows where ``fitted`` holds; weights are M1's (tf x idf,
    rows of length 1), columns are numbered in vocabulary order (commonest first).  Rows
    without a known term have empty arrays."""
    other = [c for c in split.columns if c not in (id_col, text_col)]
    counts = materialise(term_counts(split, id_col, text_col))
    known = split.where(fitted).select(id_col)
    n_docs = known.agg(F.count(F.lit(1))).scalar()
    terms = (counts.join(known, id_col, "left_semi").groupBy("term")
             .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf")))
    common = Window.orderBy(F.col("total_tf").desc(), F.col("term"))       # over max_features rows
    vocab = materialise(terms.orderBy(F.col("total_tf").desc(), F.col("term")).limit(max_features)
                        .select("term", (F.row_number().over(common) - 1).alias("col"),
                                (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf")))
    items = (counts.join(F.broadcast(vocab), "term").groupBy(id_col)
             .agg(F.sort_array(F.collect_list(F.struct("col", (F.col("tf") * F.col("idf")).alias("raw"))))
                  .alias("items")))
    norm = F.sqrt(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["raw"] * x["raw"]))
    items = items.select(id_col, F.col("items.col").alias("cols"),
                         F.transform("items", lambda x: x["raw"] / norm).alias("vals"))
    rows = split.select(id_col, *other).join(items, id_col, "left").select(
        id_col, *other, F.coalesce("cols", F.array().cast("array<int>")).alias("cols"),
        F.coalesce("vals", F.array().cast("array<double>")).alias("vals"))
    return rows, vocab.count()


@dataclass
class Baseline:
    """A fitted baseline: test predictions, class names and the models with their gradients."""
    predictions: DataFrame            # key, true_diagnosis, predicted_diagnosis
    labels: list[str]
    classes: list[int]                # class number of each model
    weights: np.ndarray               # one line per model, intercept last
    gradient_norms: np.ndarray
    n_features: int
    n_train: int
    passes: int

    def models(self) -> DataFrame:
        """label, n_features, weight_norm, intercept, gradient_norm: one row per model."""
        spark = self.predictions.sparkSession
        return spark.createDataFrame(
            [(self.labels[k], self.n_features, float(np.linalg.norm(w)), float(w[-1]), float(g))
             for k, w, g in zip(self.classes, self.weights, self.gradient_norms)],
            "label string, n_features long, weight_norm double, intercept double, gradient_norm double")


def fit_baseline(data: DataFrame, text_col: str = "text", label_col: str = "label",
                 key: str = "doc_id", test_size: float = 0.25, c: float = 1.0,
                 max_features: int = MAX_FEATURES, seed: int = 42) -> Baseline:
    """TF-IDF + logistic regression on a stratified split (M2): one model for two classes, one
    model each against the rest for more (``operators.logit``).

    Labels are numbered in sorted order over the whole split.  Class names and models
    (classes x features) are what the driver holds; rows stay distributed.  ``key`` must be
    unique, null labels are left out."""
    from casebook.operators import logit
    from casebook.operators.splits import stratified_split

    data = (data.select(key, text_col, F.col(label_col).cast("string").alias("label_str"))
            .where("label_str IS NOT NULL"))
    split = materialise(stratified_split(data, key, "label_str", test_size, seed))
    labels = sorted(r[0] for r in split.select("label_str").distinct().collect())
    number = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))]) \
        if labels else F.create_map().cast("map<string,int>")
    rows, n_features = sparse_rows(split, key, text_col, max_features)
    rows = materialise(rows.withColumn("y", number[F.col("label_str")]))
    train = rows.where("split = 'train'")
    classes = [1] if len(labels) == 2 else list(range(len(labels)))
    weights, norms, passes = logit.fit(train.select("y", "cols", "vals"), classes, n_features, c)
    told = logit.predict(rows.where("split = 'test'"), weights, classes, [key, "label_str"]) if labels else \
        rows.select(key, "label_str", F.lit(0).alias("pred"))
    names = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    preds = told.select(key, F.col("label_str").alias("true_diagnosis"),
                        F.get(names, F.col("pred")).alias("predicted_diagnosis"))
    return Baseline(preds, labels, classes, weights, norms, n_features, train.count(), passes)


def logit_baseline(data: DataFrame, text_col: str = "text", label_col: str = "label",
                   key: str = "doc_id", test_size: float = 0.25, c: float = 1.0,
                   max_features: int = MAX_FEATURES, seed: int = 42):
    """(predictions [key, true_diagnosis, predicted_diagnosis], n_features, n_train) of ``fit_baseline``."""
    found = fit_baseline(data, text_col, label_col, key, test_size, c, max_features, seed)
    return found.predictions, found.n_features, found.n_train


def baseline_report(preds: DataFrame, n_features: int, n_train: int) -> DataFrame:
    """metric, value — accuracy, macro / weighted F1, class / train / test / feature counts, and
    per class ``precision[label]``, ``recall[label]``, ``f1[label]``, ``support[label]`` (M3)."""
    from casebook.operators.metrics import class_report, overall_scores
    s = overall_scores(preds)
    n_classes = preds.select("true_diagnosis").distinct().agg(F.count(F.lit(1))).scalar()
    overall = s.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
        F.struct(F.lit("f1_macro").alias("metric"), F.col("f1_macro").alias("value")),
        F.struct(F.lit("f1_weighted").alias("metric"), F.col("f1_weighted").alias("value")),
        F.struct(F.lit("n_test").alias("metric"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("n_train").alias("metric"), F.lit(float(n_train)).alias("value")),
        F.struct(F.lit("n_features").alias("metric"), F.lit(float(n_features)).alias("value")),
        F.struct(F.lit("n_classes").alias("metric"), n_classes.cast("double").alias("value")),
    )).alias("m")).select("m.metric", "m.value")
    per_class = class_report(preds).select(F.col("label"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
        for c in ("precision", "recall", "f1", "support")])).alias("m")).select(
        F.concat("m.name", F.lit("["), "label", F.lit("]")).alias("metric"), "m.value")
    return overall.unionByName(per_class)


def encode_labels(df: DataFrame, label_col: str = "label", name: str = "label_index") -> DataFrame:
    """Adds ``name`` = position of the label among the sorted distinct labels.

    The ranking runs over the distinct labels only — the class set of a classifier, not the
    rows — and is joined back to the rows (AQE broadcasts it when it is small).
    """
    from casebook.operators.ordering import global_index
    classes = df.select(F.col(label_col).cast("string").alias("_l")).where(F.col("_l").isNotNull()) \
        .distinct()
    ranked = global_index(classes, "_l", name).withColumn(name, F.col(name).cast("int"))
    return df.join(ranked, F.col(label_col).cast("string") == F.col("_l"), "left").drop("_l")
