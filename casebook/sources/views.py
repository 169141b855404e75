"""Adapter views: the clinical tables the operators expect, derived from the driver tables.

The driver ships TPC-H-like tables; each view below renames / derives columns so the
clinical operators run on data that grows with the scale factor.  All views are lazy
DataFrames: Catalyst prunes the columns a query does not use down to the Parquet scan.

Join strategy: ``nation`` (25 rows) and ``region`` (5 rows) have a size fixed by the
TPC-H specification, so they are broadcast explicitly.  Every other join is left to
Catalyst + AQE, which broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise falls back to a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.sources.tables import read_table

# Fixed values of the adapter (shared with the DuckDB oracle in casebook.plans.oracle).
BIRTH_EPOCH = "1940-01-01"      # BIRTHDATE = BIRTH_EPOCH + (c_custkey % BIRTH_SPREAD) days
BIRTH_SPREAD = 20000
OBS_NA_EVERY = 10               # every 10th event carries a non-numeric VALUE 'n/a'
PRED_CONF_SCALE = 300.0         # prediction confidence = value / 300
N_AGENTS = 4                    # prediction agent = 'agent_' || user_id % 4


def _date(c: str) -> Column:
    return F.to_date(F.col(c))


def patients(spark: SparkSession, sf: str) -> DataFrame:
    """ID, BIRTHDATE, GENDER, RACE, ETHNICITY — one row per customer."""
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf, "region").select("r_regionkey", "r_name")
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
             .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left")
             .select(F.col("c_custkey").alias("ID"),
                     F.date_add(F.lit(BIRTH_EPOCH).cast("date"),
                                (F.col("c_custkey") % BIRTH_SPREAD).cast("int")).alias("BIRTHDATE"),
                     F.col("c_mktsegment").alias("GENDER"),
                     F.col("n_name").alias("RACE"),
                     F.col("r_name").alias("ETHNICITY")))


def conditions(spark: SparkSession, sf: str) -> DataFrame:
    """START, STOP, PATIENT, CODE, DESCRIPTION — one row per line item of an order."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus",
                                                  "l_shipdate")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = read_table(spark, sf, "part").select("p_partkey", "p_name")
    return (li.join(o, li.l_orderkey == o.o_orderkey, "inner")
              .join(p, li.l_partkey == p.p_partkey, "left")
              .select(_date("o_orderdate").alias("START"),
                      F.when(F.col("l_linestatus") == "O", F.lit(None).cast("date"))
                       .otherwise(_date("l_shipdate")).alias("STOP"),
                      F.col("o_custkey").alias("PATIENT"),
                      F.col("l_partkey").cast("string").alias("CODE"),
                      F.col("p_name").alias("DESCRIPTION")))


def encounters(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("ID"), _date("o_orderdate").alias("DATE"),
                    F.col("o_custkey").alias("PATIENT"),
                    F.col("o_orderpriority").alias("DESCRIPTION"))


def observations(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.select(_date("ts").alias("DATE"), F.col("user_id").alias("PATIENT"),
                    F.col("event_type").alias("DESCRIPTION"),
                    F.when(F.col("event_id") % OBS_NA_EVERY == 0, F.lit("n/a"))
                     .otherwise(F.col("value").cast("string")).alias("VALUE"))


# DESCRIPTION source per lineitem ⋈ part view (medications / procedures / allergies).
LINE_VIEW_ATTR = {"medications": "p_brand", "procedures": "p_type", "allergies": "p_name"}


def line_views(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """medications / procedures / allergies: DESCRIPTION from part, CODE = line number."""
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = read_table(spark, sf, "part").select("p_partkey", LINE_VIEW_ATTR[name])
    return (li.join(p, li.l_partkey == p.p_partkey, "left")
              .select(F.col("l_orderkey").alias("ENCOUNTER"),
                      F.col("l_linenumber").cast("string").alias("CODE"),
                      F.col(LINE_VIEW_ATTR[name]).alias("DESCRIPTION")))


def immunizations(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.select(_date("l_shipdate").alias("DATE"), F.col("l_orderkey").alias("PATIENT"),
                     F.col("l_linenumber").cast("string").alias("CODE"))


def agent_answers(spark: SparkSession, sf: str) -> DataFrame:
    """case_id, agent_id, diagnosis, confidence (raw, unclamped), answer_seq (input order).

    answer_seq = line number, then part key, packed in one long (part keys < 2^40) so the
    "first seen" aggregate stays a hash aggregate.
    """
    li = read_table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("case_id"),
                     F.col("l_linenumber").cast("string").alias("agent_id"),
                     F.col("l_returnflag").alias("diagnosis"),
                     (F.col("l_discount") * 12 - 0.1).alias("confidence"),
                     (F.col("l_linenumber").cast("long") * F.lit(1 << 40) + F.col("l_partkey"))
                     .alias("answer_seq"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """sample_id, true_diagnosis, predicted_diagnosis, confidence, agent_used, patient, seconds.

    The prediction for an event is the type of the event before it (event_id - 1): an
    equi-join on a unique key, so no hot group ever lands in one task.
    """
    e = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    prev = read_table(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("next_id"), F.col("event_type").alias("prev_type"))
    return (e.join(prev, e.event_id == prev.next_id, "left")
             .select(F.col("event_id").alias("sample_id"),
                     F.col("event_type").alias("true_diagnosis"),
                     F.col("prev_type").alias("predicted_diagnosis"),
                     (F.col("value") / PRED_CONF_SCALE).alias("confidence"),
                     F.concat(F.lit("agent_"), (F.col("user_id") % N_AGENTS).cast("string"))
                      .alias("agent_used"),
                     F.nullif(F.col("user_id"), F.lit(0)).alias("patient"),
                     (F.col("value") / 1000).alias("seconds")))


def latencies(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("operation"),
                    F.col("value").alias("duration_ms"),
                    F.col("value").isNotNull().alias("success"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("note_id"), "text", "lang")


# ---------------------------------------------------------------- answer texts
# Texts an answer-parsing step receives, derived row by row from lineitem.  Defects are
# seeded by line number so every parser branch is exercised (fixed values of the adapter):
#   refined JSON: 4 -> 'reasoning' missing, 5 -> extra key, 6 -> non-numeric confidence,
#                 7 -> truncated text (not JSON);
#   delimited:    6 -> confidence 'n/a', 7 -> two fields only.

def refined_outputs(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    ln = F.col("l_linenumber")
    conf = F.col("l_discount") * 12 - 0.1
    reasoning = F.concat(F.lit("status "), F.col("l_linestatus"))
    good = F.to_json(F.struct(F.col("l_returnflag").alias("diagnosis"),
                              reasoning.alias("reasoning"), conf.alias("confidence")))
    raw = (F.when(ln == 4, F.to_json(F.struct(F.col("l_returnflag").alias("diagnosis"),
                                              conf.alias("confidence"))))
            .when(ln == 5, F.to_json(F.struct(F.col("l_returnflag").alias("diagnosis"),
                                              reasoning.alias("reasoning"),
                                              conf.alias("confidence"),
                                              F.col("l_linenumber").alias("agent"))))
            .when(ln == 6, F.to_json(F.struct(F.col("l_returnflag").alias("diagnosis"),
                                              reasoning.alias("reasoning"),
                                              F.lit("high").alias("confidence"))))
            .when(ln == 7, F.substring(good, 1, 12))
            .otherwise(good))
    return li.select(F.col("l_orderkey").alias("case_id"), ln.alias("line"), raw.alias("raw"))


def delimited_lines(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    ln = F.col("l_linenumber")
    conf = (F.col("l_discount") * 12 - 0.1).cast("string")
    head = F.concat(ln.cast("string"), F.lit("::"), F.col("l_returnflag"))
    line = (F.when(ln == 7, head)
             .when(ln == 6, F.concat(head, F.lit("::n/a")))
             .otherwise(F.concat(head, F.lit("::"), conf)))
    return li.select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("part"),
                     line.alias("line"))


def sectioned_answers(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    secondary = F.when(F.col("l_linestatus") == "O", F.lit("None")).otherwise(
        F.concat(F.col("l_linestatus"), F.lit(", "), F.col("l_returnflag")))
    text = F.concat(F.lit("Primary Diagnosis: "), F.col("l_returnflag"),
                    F.lit("\nSecondary Diagnoses: "), secondary,
                    F.lit("\nRationale: line "), F.col("l_linenumber").cast("string"))
    return li.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"),
                     F.col("l_partkey").alias("part"), text.alias("answer"))


# ---------------------------------------------------------------- lookup tables derived from the data

DOMAIN_MAX_SIZE = 25   # parts with p_size <= 25 are mapped to a domain; the rest stay 'general'


def domain_map(spark: SparkSession, sf: str) -> DataFrame:
    """code -> domain lookup (unique codes): a part's type, for the smaller parts."""
    p = read_table(spark, sf, "part")
    return p.where(F.col("p_size") <= DOMAIN_MAX_SIZE).select(
        F.col("p_partkey").cast("string").alias("code"), F.lower("p_type").alias("domain"))


def labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text, label — documents that carry a quality label (baseline input)."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    lab = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    return d.join(lab, "doc_id")
