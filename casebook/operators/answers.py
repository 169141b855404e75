"""Candidate assembly and answer parsing.

All parsing is column expressions: JSON through ``json_object_keys`` / ``get_json_object``,
delimited lines through ``split``, sections through ``regexp_extract``.  Rows that do not
parse are kept in a quarantine frame with a reason instead of aborting the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.columns import clamp01, format_fixed, strip_ws

REFINED_KEYS = ["confidence", "diagnosis", "reasoning"]   # exactly these keys, sorted


# ---------------------------------------------------------------- T4 / T4b

def candidate_block(agent: Column, answer: Column, conf: Column) -> Column:
    """``[agent] (confidence=0.82):\\nanswer\\n``; the confidence part is omitted when null."""
    c = F.when(conf.isNull(), F.lit("")).otherwise(
        F.concat(F.lit(" (confidence="), format_fixed(conf, 2), F.lit(")")))
    return F.concat(F.lit("["), agent, F.lit("]"), c, F.lit(":\n"), strip_ws(answer), F.lit("\n"))


def refinement_prompts(cases: DataFrame, candidates: DataFrame, case_col: str = "case_id",
                       text_col: str = "text", order_cols=("agent_id", "answer_seq")) -> DataFrame:
    """case_id, prompt — ``USER CASE:`` text plus the candidate blocks in candidate order.

    The reference's template leaves 8 leading blanks (dedent after interpolation); they are
    dropped here.  Cases without candidates are absent (inner join).
    """
    blocks = candidates.select(case_col, F.struct(*order_cols).alias("_o"),
                               candidate_block(F.col("agent_id"), F.col("answer"),
                                               F.col("confidence")).alias("_b"))
    joined = blocks.groupBy(case_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_b"))),
                                 lambda x: x["_b"]), "\n").alias("_blocks"))
    return cases.select(F.col(case_col), F.col(text_col)).join(joined, case_col).select(
        case_col,
        F.concat(F.lit("USER CASE:\n"), strip_ws(F.col(text_col)), F.lit("\n\nCANDIDATE ANSWERS:\n"),
                 F.col("_blocks"), F.lit("\n")).alias("prompt"))


def numbered_agent_list(cases: DataFrame, candidates: DataFrame, case_col: str = "case_id",
                        text_col: str = "text", order_cols=("agent_id", "answer_seq")) -> DataFrame:
    """case_id, prompt — ``Patient Prompt:`` + ``N. Agent: a, Diagnosis: d, Confidence: c``."""
    items = candidates.select(case_col, F.struct(*order_cols).alias("_o"),
                              F.col("agent_id"), F.col("answer"), F.col("confidence"))
    agg = items.groupBy(case_col).agg(
        F.array_sort(F.collect_list(F.struct("_o", "agent_id", "answer", "confidence"))).alias("_l"))
    lines = F.transform(F.col("_l"), lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(". Agent: "), x["agent_id"], F.lit(", Diagnosis: "),
        x["answer"], F.lit(", Confidence: "),
        F.when(x["confidence"].isNull(), F.lit("N/A"))
         .otherwise(format_fixed(x["confidence"], 2))))
    return cases.select(case_col, text_col).join(agg, case_col).select(
        case_col, F.concat(F.lit("Patient Prompt:\n"), strip_ws(F.col(text_col)),
                           F.lit("\n\nAgent Diagnoses:\n"), F.array_join(lines, "\n"))
        .alias("prompt"))


# ---------------------------------------------------------------- T5

def parse_refined(raw: DataFrame, text_col: str = "raw") -> DataFrame:
    """Adds ok, reject_reason, diagnosis, reasoning, confidence (clamped) for refined JSON.

    Accepted iff the text is a JSON object with exactly the keys diagnosis, reasoning and
    confidence, and the confidence converts to a number.
    """
    t = F.col(text_col)
    keys = F.array_sort(F.json_object_keys(t))
    conf = F.get_json_object(t, "$.confidence").try_cast("double")
    reason = (F.when(keys.isNull(), "not_a_json_object")
               .when(keys != F.array(*[F.lit(k) for k in REFINED_KEYS]), "wrong_keys")
               .when(conf.isNull(), "bad_confidence"))
    return raw.select(
        "*", reason.alias("reject_reason"), reason.isNull().alias("ok"),
        F.when(reason.isNull(), F.get_json_object(t, "$.diagnosis")).alias("diagnosis"),
        F.when(reason.isNull(), F.get_json_object(t, "$.reasoning")).alias("reasoning"),
        F.when(reason.isNull(), clamp01(conf)).alias("confidence"))


# ---------------------------------------------------------------- T6

def parse_sections(df: DataFrame, text_col: str = "answer") -> DataFrame:
    """primary, secondary (array), rationale from a ``Primary Diagnosis:`` style answer.

    ``Secondary Diagnoses: None`` (any case) or an absent section give an empty array;
    otherwise the section is split on commas / semicolons and trimmed.
    """
    t = F.col(text_col)

    def section(label: str) -> Column:
        v = F.regexp_extract(t, f"(?im)^\\s*{label}:[ \\t]*(.*?)\\s*$", 1)
        return F.when(v == "", F.lit(None)).otherwise(v)

    sec = section("Secondary Diagnoses")
    items = F.filter(F.transform(F.split(sec, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    secondary = F.when(sec.isNull() | (F.lower(sec) == "none"),
                       F.array().cast("array<string>")).otherwise(items)
    return df.select("*", section("Primary Diagnosis").alias("primary"),
                     secondary.alias("secondary"), section("Rationale").alias("rationale"))


# ---------------------------------------------------------------- T10

def parse_delimited(lines: DataFrame, text_col: str = "line", sep: str = "::") -> DataFrame:
    """Adds ok, reject_reason, agent_id, diagnosis, confidence for ``agent::diagnosis::conf``."""
    parts = F.split(strip_ws(F.col(text_col)), sep.replace(":", "\\:"), -1)
    conf = F.trim(F.try_element_at(parts, F.lit(3))).try_cast("double")
    reason = (F.when(F.size(parts) != 3, "wrong_field_count")
               .when(conf.isNull(), "bad_confidence"))
    return lines.select(
        "*", reason.alias("reject_reason"), reason.isNull().alias("ok"),
        F.when(reason.isNull(), F.try_element_at(parts, F.lit(1))).alias("agent_id"),
        F.when(reason.isNull(), F.try_element_at(parts, F.lit(2))).alias("diagnosis"),
        F.when(reason.isNull(), clamp01(conf)).alias("confidence"))
