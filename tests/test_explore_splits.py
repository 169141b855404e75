"""Exploration statistics (A6, A23, A24), splits (P1–P4) and ordering helpers."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from casebook.operators import explore as E
from casebook.operators import ordering as OR
from casebook.operators import splits as S


def test_histogram_last_edge_inclusive_and_degenerate(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 10]], "x double")
    h = {r.bin: r.n for r in E.equal_width_histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 0, 3: 0, 4: 1}
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    r = E.equal_width_histogram(one, "x", 2).orderBy("bin").collect()
    assert [(x.bin_lo, x.bin_hi, x.n) for x in r] == [(2.5, 3.0, 0), (3.0, 3.5, 2)]


def test_describe_matches_pandas(spark):
    vals = [random.Random(3).randint(1, 30) for _ in range(101)]
    got = E.describe(spark.createDataFrame([(v,) for v in vals], "n long"), "n").collect()[0]
    want = pd.Series(vals, dtype=float).describe()
    for k, w in (("n", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"),
                 ("q50", "50%"), ("q75", "75%"), ("max", "max")):
        assert getattr(got, k) == pytest.approx(round(want[w], 6))


def test_box_stats_whiskers(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([("a", float(v)) for v in vals], "g string, x double")
    r = E.box_stats(df, "g", "x").collect()[0]
    assert (r.q1, r.median, r.q3, r.whisker_lo, r.whisker_hi, r.n_outliers) == (3.0, 5.0, 7.0, 1.0, 8.0, 1)


def test_global_index_matches_sort(spark):
    rnd = random.Random(1)
    keys = rnd.sample(range(10_000), 500)
    df = spark.createDataFrame([(k, k % 3) for k in keys], "k long, g long")
    out = OR.global_index(df, "k", "i", partition_cols=("g",), group_count="n")
    got = {(r.g, r.k): (r.i, r.n) for r in out.collect()}
    for g in range(3):
        ks = sorted(k for k in keys if k % 3 == g)
        for i, k in enumerate(ks):
            assert got[(g, k)] == (i, len(ks))


def test_split_sizes_are_exact_and_repeatable(spark):
    df = spark.createDataFrame([(i, "big" if i < 95 else "tiny") for i in range(100)],
                               "id long, domain string")
    a = S.split_by_hash(df, "id", ("domain",), 0.2, 42, S.MIN_DOMAIN_ROWS)
    counts = {(r.domain, r.split): r["count"] for r in a.groupBy("domain", "split").count().collect()}
    assert counts == {("big", "train"): 76, ("big", "test"): 19}     # tiny (5 rows) not split
    b = S.split_by_hash(df, "id", ("domain",), 0.2, 42, S.MIN_DOMAIN_ROWS)
    assert sorted(a.collect()) == sorted(b.collect())


def test_global_index_of_sparse_and_text_keys(spark):
    keys = list(range(1000)) + [2 ** 50]
    out = OR.global_index(spark.createDataFrame([(k,) for k in keys], "k long"), "k", "i").collect()
    assert {r.k: r.i for r in out} == {k: i for i, k in enumerate(keys)}
    text = [f"{i:04x}-uuid" for i in range(200)] + [None]
    out = OR.global_index(spark.createDataFrame([(k,) for k in text], "k string"), "k", "i").collect()
    assert {r.k: r.i for r in out} == {k: i for i, k in enumerate([None] + sorted(text[:-1]))}
    assert OR.global_index(spark.createDataFrame([], "k string"), "k", "i").count() == 0


def test_general_is_split_whatever_its_size(spark):
    ds = spark.createDataFrame([(f"id-{i}", "general") for i in range(8)] + [("id-1", "cardio")],
                               "patient_id string, domain string")
    got = S.split_domains(ds).groupBy("domain", "split").count().collect()
    assert {(r.domain, r.split): r["count"] for r in got} == {("general", "train"): 6, ("general", "test"): 2}
    st = {r.domain: (r.total, r.train, r.test) for r in S.domain_stats(ds).collect()}
    assert st == {"general": (8, 6, 2), "cardio": (1, 0, 0)}


def test_numeric_values_take_plain_numbers_only(spark):
    df = spark.createDataFrame([(v, "k") for v in ("1", " 2.5 ", "-3e2", "1d", "2f", "NaN", "x", "", ".5", "+7.")],
                               "VALUE string, DESCRIPTION string")
    assert sorted(r.value for r in E.numeric_values(df, "k").collect()) == [-300.0, 0.5, 1.0, 2.5, 7.0]


def test_domain_stats_and_lookup(spark):
    samples = spark.createDataFrame([(i, str(i % 4)) for i in range(40)] + [(99, None)],
                                    "patient_id long, label string")
    dmap = spark.createDataFrame([("1", "cardio"), ("2", "general")], "code string, domain string")
    ds = S.domain_samples(samples, dmap)
    st = {r.domain: (r.total, r.train, r.test) for r in S.domain_stats(ds).collect()}
    assert st == {"general": (41, 32, 9), "cardio": (10, 0, 0)}


def test_stratified_split_falls_back(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b") for i in range(31)], "id long, label string")
    s = S.stratified_split(df, "id", "label", 0.25)
    assert s.where(F.col("split") == "train").count() == int(31 * 0.75)   # 'b' has one row
    df2 = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(28)], "id long, label string")
    c = {(r.label, r.split): r["count"] for r in S.stratified_split(df2, "id", "label", 0.25)
         .groupBy("label", "split").count().collect()}
    assert c == {("a", "train"): 15, ("a", "test"): 5, ("b", "train"): 6, ("b", "test"): 2}


def test_sample_examples_and_prompt_split(spark):
    df = spark.createDataFrame([(i, f"q{i}\nAI: a{i}") for i in range(20)] + [(99, "abcdef")],
                               "patient_id long, text string")
    assert S.sample_examples(df, "patient_id", 5).count() == 5
    out = {r.patient_id: (r.prompt, r.expected) for r in S.with_prompt_expected(df).collect()}
    assert out[3] == ("q3", "AI: a3") and out[99] == ("abc", "def")


def test_stratified_sample_sizes(spark):
    from casebook.operators import evalslice as ES
    rows = [(i, f"c{i % 7 if i < 600 else 99}") for i in range(1000)]   # code c99 holds 400 rows
    df = spark.createDataFrame(rows, "patient_id long, icd10_code string")
    s = ES.stratified_sample(df, n=200)
    per_code = {r.icd10_code: r["count"] for r in s.groupBy("icd10_code").count().collect()}
    assert s.count() == 32 and max(per_code.values()) == 4      # cap = max(1, 200 // 50) = 4
    s2 = ES.stratified_sample(df, n=20)                           # cap 1 -> 8 codes, then 20
    assert s2.count() == 8
    assert ES.stratified_sample(df, n=5000).count() == 1000       # not larger than n: all rows


def test_table_counts_skip_missing_tables(spark):
    t = {r.table_name: r.n_rows for r in E.table_counts(
        {"a": spark.range(3), "missing": None, "b": spark.range(0)}).collect()}
    assert t == {"a": 3, "b": 0}
