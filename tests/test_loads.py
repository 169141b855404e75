"""Loads that arrive one after the other: key store, mergeable states, laid-out timelines."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casebook.operators import corpus, state
from casebook.sources import ingest as I
from casebook.sources import timeline
from casebook.sources.keystore import Bloom, KeyStore


def load(spark, ids, tag):
    return spark.createDataFrame([(i, f"{tag}{n}", n) for n, i in enumerate(ids)], "Id string, v string, _row long")


def test_filters_hold_their_keys_and_few_others():
    rng = np.random.default_rng(2)
    keys, others = rng.integers(-2 ** 63, 2 ** 63, 5000), rng.integers(-2 ** 63, 2 ** 63, 20000)
    bloom = Bloom(Bloom.of(keys))
    assert bloom.may_hold(keys).all() and bloom.may_hold(others).mean() < 0.01
    assert not Bloom(Bloom.of(np.zeros(0, dtype=np.int64))).may_hold(others).any()


def test_loads_equal_the_full_merge(spark):
    rnd = random.Random(3)
    loads = [[rnd.choice([None, "", *map(str, range(300))]) for _ in range(n)] for n in (200, 150, 400, 1)]
    store = KeyStore(spark, I.scratch_dir(spark, "store"), "Id", buckets=8)
    want, told = {}, []
    for n, ids in enumerate(loads):
        told.append(store.merge(load(spark, ids, f"l{n}-"), f"l{n}", ["_row"]))
        before = len(want)
        for row, i in enumerate(ids):
            want.setdefault(i, f"l{n}-{row}")
        assert (told[-1].rows_in, told[-1].rows_new) == (len(ids), len(want) - before)
        got = store.read().collect()
        assert len(got) == len(want) and {r.Id: r.v for r in got} == want
    assert told[0].buckets_read == 0


def test_a_load_reads_hit_buckets_only(spark):
    store = KeyStore(spark, I.scratch_dir(spark, "store"), "Id", buckets=16)
    store.merge(load(spark, [f"a{i}" for i in range(2000)], "x"), "one", ["_row"])
    fresh = store.merge(load(spark, [f"b{i}" for i in range(40)], "y"), "two", ["_row"])
    assert fresh.rows_new == 40 and fresh.buckets_read <= 4
    one = store.merge(load(spark, ["a7"], "z"), "three", ["_row"])
    assert (one.rows_new, one.buckets_read) == (0, 1)
    again = store.merge(load(spark, ["a7", "new"], "z"), "three", ["_row"])
    assert again.skipped and store.read().count() == 2040 and store.loads() == ["one", "two", "three"]


def test_a_load_without_its_marker_does_not_count(spark):
    path = I.scratch_dir(spark, "store")
    store = KeyStore(spark, path, "Id", buckets=4)
    with pytest.raises(FileNotFoundError):
        store.read()
    store.merge(load(spark, ["1", "2"], "a"), "one", ["_row"])
    # a load that broke off after its data
    load(spark, ["9"], "broken").drop("_row").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(
        f"{path}/data/load=two")
    assert {r.Id for r in store.read().collect()} == {"1", "2"}
    again = KeyStore(spark, path, "Id")
    assert again.buckets == 4
    again.merge(load(spark, ["2", "3"], "b").withColumn("more", F.lit(1)), "two", ["_row"])
    assert {(r.Id, r.v, r.more) for r in again.read().collect()} == {("1", "a0", None), ("2", "a1", None), ("3", "b1", 1)}
    again.merge(load(spark, [], "c"), "empty", ["_row"])
    assert again.read().count() == 3
    with pytest.raises(ValueError):
        KeyStore(spark, path, "Other")


@pytest.mark.parametrize("q", [0.0, 0.2, 0.5, 0.8, 1.0])
def test_states_of_parts_give_the_whole(spark, q):
    rnd = random.Random(9)
    rows = [(f"p{rnd.randrange(9)}" if rnd.random() < 0.9 else None, None if rnd.random() < 0.1 else
             f"20{rnd.randrange(10, 20)}-0{rnd.randrange(1, 10)}-11", rnd.choice(["x", "y", None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "PATIENT string, START string, CODE string").withColumn("START", F.to_date("START"))
    df = df.withColumn("part", F.monotonically_increasing_id() % 3).cache()
    parts = [df.where(F.col("part") == i) for i in range(4)]             # the last one is empty
    days = state.merge([state.day_counts(p) for p in parts])
    assert state.cutoff(days, q).first()[0] == corpus.temporal_cutoff(df, q).first()[0]
    if q == 0.5:
        keys = state.merge([state.key_counts(p, "PATIENT") for p in parts])
        assert {r.key: r.n for r in keys.collect()} == {
            r.PATIENT: r["count"] for r in df.where("PATIENT IS NOT NULL").groupBy("PATIENT").count().collect()}
        sets = state.merge([state.value_sets(p, ["PATIENT", "CODE"]) for p in parts])
        assert {r["column"]: r.n for r in state.distinct_counts(sets).collect()} == {"PATIENT": 9, "CODE": 2}
        assert state.cutoff(days.limit(0), q).first()[0] is None
    df.unpersist()


def test_timelines_need_no_exchange_by_patient(spark):
    cond = spark.createDataFrame(
        [(f"p{i % 40}", f"20{10 + i % 9}-01-0{1 + i % 9}", f"c{i}", f"d{i % 7}") for i in range(900)] +
        [("p1", "no date", "c", "d")], "PATIENT string, START string, CODE string, DESCRIPTION string")
    patients = spark.createDataFrame([(f"p{i}", "1980-01-01", "F", "white", "x") for i in range(40)],
                                     "ID string, BIRTHDATE string, GENDER string, RACE string, ETHNICITY string")
    laid = timeline.lay_out(cond, buckets=4)
    assert laid.count() == 900
    cut = corpus.temporal_cutoff(corpus.typed_conditions(cond)).scalar()
    want = sorted(map(tuple, corpus.corpus_samples(cond, patients, False, cutoff=cut).collect()))
    out = corpus.corpus_samples(laid, patients, False, cutoff=cut)
    assert sorted(map(tuple, out.collect())) == want and want
    for part in (corpus.patient_histories(laid, cut), corpus.first_future(laid, cut)):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(PATIENT" not in plan and "Bucketed: true" in plan


def test_buckets_grow_with_the_table():
    from casebook.sources import timeline
    assert timeline.buckets_for(0, least=16) == timeline.buckets_for(16_000_000, least=16) == 16
    assert timeline.buckets_for(216_000_000, least=16) == 216
