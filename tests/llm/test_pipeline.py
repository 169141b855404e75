"""The corpus pipeline stage by stage on a small table, and the queries' entry points."""
import importlib.util
import os

import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casebook.llm import catalog, langid_kn, quality_pu
from casebook.llm.common import fold, read, stage

from .helpers import documents
from .test_dedup import brute_components, brute_removed, plain_simhash

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(4).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))
                                    .withColumn("doc_id", F.lit(None).cast("long")))
    docs = stage(docs.unionByName(odd).withColumn("key", F.lit(5)))
    columns, n = docs.columns, docs.count()
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, SF))
        assert docs.columns == columns, name
        now = docs.count()
        assert 0 < now <= n, name
        n = now
        if name == "near_duplicates":
            assert docs.select("doc_id").distinct().count() == n
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == n
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_run_equals_brute_force(spark):
    """run() against plain Python from the models' answers on: which documents the first two
    stages accept comes from the operators themselves, everything after is done anew."""
    docs = read(spark, SF, "documents")
    told = langid_kn.identify(docs, fold("doc_id", 5) == 0).where("NOT rejected").select("doc_id")
    kept = stage(docs.join(told, "doc_id", "left_semi"))
    judged = quality_pu.classify(kept, read(spark, SF, "labels"), fold("doc_id", 4) == 2)
    kept = kept.join(judged.where("predicted = 1").select("doc_id"), "doc_id", "left_semi")
    texts = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
    groups = brute_components({i: plain_simhash(t) for i, t in texts.items()}, 2)
    ids = sorted(i for i in texts if groups[i] == i)
    removed = brute_removed([texts[i] for i in ids], 35)
    library = Tokenizer.from_file(catalog.WORD_BPE)
    want = {}
    for i, (_, gone, words, _) in zip(ids, removed):
        text = words.decode() if gone else texts[i]
        tokens = library.encode(text, add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(tokens), 4096)):
            own = tokens[a:a + 4096]
            want[i, k] = (a, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096


def test_one_row_of_each_group_stays_without_ids_of_their_own(spark):
    words = [f"w{i}" for i in range(400)]
    near = [" ".join(words + [f"v{k}"]) for k in range(4)]
    other = " ".join(f"q{i}" for i in range(300))
    assert all(bin(plain_simhash(a) ^ plain_simhash(near[0])).count("1") <= 2 for a in near)
    for ids in ([None] * 6, [5] * 4 + [7, 7], [None, 3, 3, None, None, None]):
        docs = documents(spark, near + [other, other], ids)
        kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
        assert len(kept) == 2 and {r.text == other for r in kept} == {True, False}
        first = next(r.doc_id for r in kept if r.text != other)
        assert first == min((i for i in ids[:4] if i is not None), default=None)


def test_of_equal_rows_the_first_by_its_other_columns_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents(spark, [text] * 5, [1] * 5).withColumn("word", F.concat(F.lit("v"), F.col("source")))
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), F.col("source")))        # a type without an order
    for _ in range(3):
        kept = corpus_pipeline.near_duplicates(spark, docs.repartition(4), SF).collect()
        assert [(r.doc_id, r.source, r.word) for r in kept] == [(1, "src0", "vsrc0")]
    slim = corpus_pipeline.near_duplicates(spark, docs.select("text", "doc_id"), SF)
    assert slim.columns == ["text", "doc_id"] and slim.count() == 1


def test_column_names_of_every_kind_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = ["a.b", "back`tick", "x y", "carried", "first", "casebook"]
    for name in odd:
        docs = docs.withColumn(name, F.lit(name))
    docs = stage(docs)
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, SF))
        assert docs.columns[-len(odd):] == odd, name
        assert all(list(r)[-len(odd):] == odd for r in docs.collect())
    assert "ids" in corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SF))
    assert docs.count() == 0


def test_quality_stage_drops_what_the_labels_call_bad(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf).select("doc_id", F.lit(1).alias("kept"))
    judged = spark.read.parquet(f"{sf}/labels.parquet").join(kept, "doc_id", "left")
    good = judged.where("quality = 1").agg(F.avg(F.coalesce("kept", F.lit(0)))).first()[0]
    bad = judged.where("quality = 0").agg(F.avg(F.coalesce("kept", F.lit(0)))).first()[0]
    assert good > 0.99 and bad < 0.2


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    out = catalog.QUERIES[name](spark, SF)
    rows = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(rows.fetchall())


def test_entry_has_the_queries():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
