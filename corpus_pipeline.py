"""Corpus pipeline: raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns the documents it kept, with their
columns (the last one returns packed pieces); ``run`` writes each stage's result as Parquet
in the shared checkpoint folder and reads it back as the next stage's input, so a stage
works on all and only what the stage before it kept.

Null and empty texts leave at the first stage (no letter).  Repeated rows form one group of
near duplicates; of every group exactly one row stays, also where ids are null or repeated.
Of rows that share id and text, the one whose other columns (as JSON) come first stays.  A very
long text goes through every stage whole, as one row.  An empty table passes through as an
empty table.  Extra columns of ``docs`` are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import langid_kn, packing, quality_pu, simhash_gray, substring_dedup
from casebook.llm.catalog import WORD_BPE
from casebook.llm.common import fold, named, read, row_key, stage

#: Names used beside the documents' own columns.
ROW_KEY, PIECE, OTHERS = "casebook_row_key", "casebook_piece", "casebook_others"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told and not rejected."""
    told = langid_kn.judge(docs, fold("doc_id", 5) == 0, docs.columns)
    return told.where("NOT rejected").select("doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier accepts."""
    measures = stage(quality_pu.measured(docs, "doc_id"))
    model = quality_pu.fit(measures, read(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return docs.where(quality_pu.scorer(model)("text") >= quality_pu.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id (nulls last, then the smallest row key),
    of each group of near duplicates."""
    groups = simhash_gray.near_duplicates(docs, shingle=3, limit=2)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    kept = groups.groupBy("root").agg(least.alias("first")).select(F.col("first.key").alias(ROW_KEY))
    rows = docs.withColumn(ROW_KEY, row_key()).join(kept, ROW_KEY, "left_semi")
    # of rows that share id and text the one whose other columns come first as JSON
    other = [named(c) for c in docs.columns if c not in ("doc_id", "text")]
    if not other:
        return rows.groupBy(ROW_KEY, "doc_id", "text").agg(F.count(F.lit(1))).select(*map(named, docs.columns))
    one = F.min_by(F.struct(*other), F.to_json(F.struct(*other))).alias(OTHERS)
    # the rows lie by their key already: no further exchange
    first = rows.groupBy(ROW_KEY, "doc_id", "text").agg(one)
    return first.select(*(F.col(c) if c in ("doc_id", "text") else named(c, OTHERS).alias(c)
                          for c in docs.columns))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out passages that occur elsewhere; a document without one keeps its text as it is."""
    others = tuple(c for c in docs.columns if c != "text")
    cut = substring_dedup.remove_repeats(docs, window=35, carry=others, keep_layout=True)
    text = F.col("kept").cast("string")
    size = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("carried.n_chars"))
    new = {"text": text, "n_chars": size}
    return cut.select(*(new[c].alias(c) if c in new else named(c, "carried").alias(c)
                        for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents into sequences of at most 4096 tokens.  ``ids`` holds each
    piece's token ids (little-endian 32-bit), to be put at ``offset`` of its sequence."""
    cut = stage(packing.pieces(docs, WORD_BPE, capacity=4096, end_id=1)
                .withColumn("ids_crc32", F.crc32("ids")).withColumn(PIECE, F.monotonically_increasing_id()))
    placed = packing.pack(cut.drop("ids"), capacity=4096)
    return placed.join(cut.select(PIECE, "ids"), PIECE).drop(PIECE)


STAGES = [("language_id", language_id), ("quality", quality), ("near_duplicates", near_duplicates),
          ("substring_dedup", substring_dedup_stage), ("packing", packed)]

#: Models, hashes of shingles and tokenizers have no SQL form; the tests check run() instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    for _, function in STAGES:
        docs = stage(function(spark, docs, sf_dir))
    return docs
