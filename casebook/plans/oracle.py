"""Oracle SQL (DuckDB dialect) for every registered query.

Each statement restates the adapter views of ``casebook.sources.views`` as CTEs over the
driver's tables and then computes the same result the Spark plan does, written the
straightforward way (full sorted lists, plain windows, NOT EXISTS), so the oracle also
checks the Spark-side rewrites (bounded top-k histories, two-level aggregations).
"""

from __future__ import annotations

from casebook.sources.views import (BIRTH_EPOCH, BIRTH_SPREAD, N_AGENTS, OBS_NA_EVERY,
                                    PRED_CONF_SCALE)

VIEW_SQL = {
    "patients": f"""
        SELECT c.c_custkey AS ID,
               DATE '{BIRTH_EPOCH}' + CAST(c.c_custkey % {BIRTH_SPREAD} AS INTEGER) AS BIRTHDATE,
               c.c_mktsegment AS GENDER, n.n_name AS RACE, r.r_name AS ETHNICITY
        FROM customer c
        LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
        LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "conditions": """
        SELECT CAST(o.o_orderdate AS DATE) AS START,
               CASE WHEN l.l_linestatus = 'O' THEN NULL ELSE CAST(l.l_shipdate AS DATE) END AS STOP,
               o.o_custkey AS PATIENT, CAST(l.l_partkey AS VARCHAR) AS CODE,
               p.p_name AS DESCRIPTION
        FROM lineitem l
        JOIN orders o ON l.l_orderkey = o.o_orderkey
        LEFT JOIN part p ON l.l_partkey = p.p_partkey""",
    "encounters": """
        SELECT o_orderkey AS ID, CAST(o_orderdate AS DATE) AS DATE, o_custkey AS PATIENT,
               o_orderpriority AS DESCRIPTION
        FROM orders""",
    "observations": f"""
        SELECT CAST(ts AS DATE) AS DATE, user_id AS PATIENT, event_type AS DESCRIPTION,
               CASE WHEN event_id % {OBS_NA_EVERY} = 0 THEN 'n/a'
                    ELSE CAST(value AS VARCHAR) END AS VALUE
        FROM events""",
    "medications": """
        SELECT l.l_orderkey AS ENCOUNTER, CAST(l.l_linenumber AS VARCHAR) AS CODE,
               p.p_brand AS DESCRIPTION
        FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey""",
    "procedures": """
        SELECT l.l_orderkey AS ENCOUNTER, CAST(l.l_linenumber AS VARCHAR) AS CODE,
               p.p_type AS DESCRIPTION
        FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey""",
    "allergies": """
        SELECT l.l_orderkey AS ENCOUNTER, CAST(l.l_linenumber AS VARCHAR) AS CODE,
               p.p_name AS DESCRIPTION
        FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey""",
    "immunizations": """
        SELECT CAST(l_shipdate AS DATE) AS DATE, l_orderkey AS PATIENT,
               CAST(l_linenumber AS VARCHAR) AS CODE
        FROM lineitem""",
    "agent_answers": """
        SELECT l_orderkey AS case_id, CAST(l_linenumber AS VARCHAR) AS agent_id,
               l_returnflag AS diagnosis, l_discount * 12 - 0.1 AS confidence,
               l_linenumber AS seq1, l_partkey AS seq2, 0 AS seq3
        FROM lineitem""",
    "predictions": f"""
        SELECT e.event_id AS sample_id, e.event_type AS true_diagnosis,
               p.event_type AS predicted_diagnosis, e.value / {PRED_CONF_SCALE} AS confidence,
               'agent_' || CAST(e.user_id % {N_AGENTS} AS VARCHAR) AS agent_used,
               nullif(e.user_id, 0) AS patient, e.value / 1000 AS seconds
        FROM events e LEFT JOIN events p ON p.event_id + 1 = e.event_id""",
    "latencies": """
        SELECT ts AS timestamp, event_type AS operation, value AS duration_ms,
               value IS NOT NULL AS success
        FROM events""",
    "notes": """
        SELECT doc_id AS note_id, text, lang FROM documents""",
}


def with_views(body: str, *views: str, extra: dict | None = None) -> str:
    """Prefix ``body`` with CTEs for the named adapter views (and extra named CTEs)."""
    parts = [f"{v} AS ({VIEW_SQL[v]}\n)" for v in views]
    parts += [f"{k} AS ({v}\n)" for k, v in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


# ---------------------------------------------------------------- corpus

def _corpus_sql(allow_repeats: bool) -> dict:
    """Samples in five small steps: the cutoff day, each condition marked as before or after it,
    the told history, the next event, and the sentence."""
    unseen = "" if allow_repeats else """
            ANTI JOIN (SELECT DISTINCT PATIENT, CODE FROM marked WHERE is_before) known
              ON known.PATIENT = ahead.PATIENT AND known.CODE = ahead.target"""
    return {
        "cut": "SELECT quantile_disc(START, 0.8) AS on_day FROM conditions",
        "marked": """
            SELECT PATIENT, START, CODE, DESCRIPTION, START < on_day AS is_before,
                   concat(CODE, ' (', DESCRIPTION, ')') AS item,
                   CODE IS NOT NULL AND DESCRIPTION IS NOT NULL AS whole
            FROM conditions, cut WHERE START IS NOT NULL""",
        "told": """
            SELECT PATIENT,
                   string_agg(item, '; ' ORDER BY place) FILTER (WHERE whole AND place <= 40) AS story
            FROM (SELECT PATIENT, item, whole,
                         row_number() OVER (PARTITION BY PATIENT
                                            ORDER BY whole DESC, START, CODE, DESCRIPTION) AS place
                  FROM marked WHERE is_before) placed
            GROUP BY PATIENT""",
        "ahead": """
            SELECT DISTINCT ON (PATIENT) PATIENT, CODE AS target
            FROM marked WHERE NOT is_before
            ORDER BY PATIENT, START, CODE NULLS FIRST""",
        "person": """
            SELECT ID, min(BIRTHDATE) AS born, min(GENDER) AS gender, min(RACE) AS race,
                   min(ETHNICITY) AS ethnicity
            FROM patients GROUP BY ID""",
        "samples": f"""
            SELECT told.PATIENT AS patient_id,
                   format('{{}}-year-old {{}} {{}} {{}} patient. History of: {{}}.{{}}AI: ',
                          ifnull(CAST(CAST(trunc((on_day - born) / 365.25) AS INTEGER) AS VARCHAR),
                                 'unknown-age'),
                          ifnull(nullif(gender, ''), 'unknown-gender'),
                          lower(ifnull(nullif(race, ''), 'unknown-race')),
                          lower(ifnull(nullif(ethnicity, ''), 'unknown-ethnicity')),
                          ifnull(story, 'no previous diagnoses'), repeat(chr(10), 2))
                   || CAST(target AS VARCHAR) AS text,
                   CAST(target AS VARCHAR) AS label
            FROM told JOIN ahead USING (PATIENT){unseen}
            JOIN person ON person.ID = told.PATIENT, cut""",
    }


def corpus_prompts_sql(allow_repeats: bool = True) -> str:
    return with_views("SELECT patient_id, text, label FROM samples", "conditions", "patients",
                      extra=_corpus_sql(allow_repeats))


def corpus_count_sql(allow_repeats: bool = True) -> str:
    return with_views("SELECT CAST(count(*) AS BIGINT) AS n_rows FROM samples", "conditions",
                      "patients", extra=_corpus_sql(allow_repeats))


# ---------------------------------------------------------------- exploration

AS_OF = "2025-01-01"
OBS_KIND = "purchase"


def hist_sql(src: str, col: str, bins: int) -> str:
    """Equal-width histogram of ``col`` from the SELECT ``src`` (same formula as Spark)."""
    return f"""
    , vals AS (SELECT CAST({col} AS DOUBLE) AS x FROM ({src}) s WHERE {col} IS NOT NULL),
    st0 AS (SELECT min(x) AS lo0, max(x) AS hi0 FROM vals),
    st AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                  CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM st0),
    b AS (SELECT least(CAST(floor((x - lo) * ({bins} / (hi - lo))) AS INTEGER), {bins - 1}) AS bin,
                 count(*) AS n
          FROM vals, st GROUP BY 1),
    grid AS (SELECT CAST(range AS INTEGER) AS bin,
                    lo + (hi - lo) * CAST(range AS INTEGER) / {bins} AS bin_lo,
                    lo + (hi - lo) * (CAST(range AS INTEGER) + 1) / {bins} AS bin_hi
             FROM range({bins}), st)
    SELECT grid.bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi,
           CAST(coalesce(b.n, 0) AS BIGINT) AS n
    FROM grid LEFT JOIN b ON grid.bin = b.bin"""


def describe_sql(src: str, col: str) -> str:
    return f"""
    SELECT CAST(count(x) AS BIGINT) AS n, round(avg(x), 6) AS mean,
           round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min,
           round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
           round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max
    FROM (SELECT CAST({col} AS DOUBLE) AS x FROM ({src}) s WHERE {col} IS NOT NULL) v"""


def top_sql(view: str, keys: list[str], n: int, label: str | None = None) -> str:
    k = ", ".join(keys)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in keys)
    lab = f", substr({label}, 1, 50) || '...' AS label" if label else ""
    order = ", ".join(f"{c} ASC" for c in keys)
    return with_views(f"""
        SELECT {k}, CAST(count(*) AS BIGINT) AS n{lab}
        FROM {view} WHERE {notnull} GROUP BY {k}
        ORDER BY n DESC, {order} LIMIT {n}""", view)


DEMOGRAPHICS = f"""
    SELECT GENDER, date_diff('day', b, DATE '{AS_OF}') / 365.25 AS age
    FROM (SELECT GENDER, TRY_CAST(CAST(BIRTHDATE AS VARCHAR) AS DATE) AS b FROM patients
          WHERE BIRTHDATE IS NOT NULL AND GENDER IS NOT NULL) p
    WHERE b IS NOT NULL AND date_diff('day', b, DATE '{AS_OF}') / 365.25 >= 0"""

NUMERIC_VALUES = f"""
    SELECT TRY_CAST(trim(VALUE) AS DOUBLE) AS value FROM observations
    WHERE DESCRIPTION = '{OBS_KIND}' AND VALUE IS NOT NULL
      AND TRY_CAST(trim(VALUE) AS DOUBLE) IS NOT NULL"""

COND_VS_ENC = """
    SELECT c.PATIENT, c.num_conditions, e.num_encounters
    FROM (SELECT PATIENT, CAST(count(*) AS BIGINT) AS num_conditions FROM conditions
          GROUP BY PATIENT) c
    JOIN (SELECT PATIENT, CAST(count(*) AS BIGINT) AS num_encounters FROM encounters
          GROUP BY PATIENT) e ON c.PATIENT = e.PATIENT"""

AGE_AT_ENCOUNTER = """
    SELECT ec.encounter_id, ec.DESCRIPTION,
           CAST(date_diff('year', pc.b, ec.d) AS INTEGER) AS age_at_encounter
    FROM (SELECT ID AS encounter_id, PATIENT, DESCRIPTION,
                 TRY_CAST(CAST(DATE AS VARCHAR) AS DATE) AS d FROM encounters) ec
    JOIN (SELECT ID, TRY_CAST(CAST(BIRTHDATE AS VARCHAR) AS DATE) AS b FROM patients) pc
      ON ec.PATIENT = pc.ID
    WHERE ec.d IS NOT NULL AND pc.b IS NOT NULL AND ec.d >= pc.b
      AND ec.DESCRIPTION IN (SELECT DESCRIPTION FROM encounters WHERE DESCRIPTION IS NOT NULL
                             GROUP BY DESCRIPTION ORDER BY count(*) DESC, DESCRIPTION LIMIT 10)
      AND date_diff('year', pc.b, ec.d) >= 0"""

EXPLORE = {
    "table_counts": with_views(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM {t}"
        for t in ("patients", "conditions", "observations", "encounters", "medications",
                  "procedures", "allergies", "immunizations")),
        "patients", "conditions", "observations", "encounters", "medications", "procedures",
        "allergies", "immunizations"),
    "gender_counts": with_views(
        "SELECT GENDER, CAST(count(*) AS BIGINT) AS n FROM demo GROUP BY GENDER",
        "patients", extra={"demo": DEMOGRAPHICS}),
    "top_encounters": top_sql("encounters", ["DESCRIPTION"], 20, "DESCRIPTION"),
    "top_observations": top_sql("observations", ["DESCRIPTION"], 20, "DESCRIPTION"),
    "top_medications": top_sql("medications", ["DESCRIPTION"], 20, "DESCRIPTION"),
    "top_procedures": top_sql("procedures", ["DESCRIPTION"], 20, "DESCRIPTION"),
    "top_allergies": top_sql("allergies", ["DESCRIPTION"], 20, "DESCRIPTION"),
    "top_immunizations": top_sql("immunizations", ["CODE"], 20, "CODE"),
    "top_conditions": top_sql("conditions", ["DESCRIPTION", "CODE"], 20, "DESCRIPTION"),
    "conditions_per_patient_summary": with_views(
        describe_sql("SELECT PATIENT, count(*) AS n FROM conditions GROUP BY PATIENT", "n"),
        "conditions"),
    "value_summary": with_views(describe_sql(NUMERIC_VALUES, "value"), "observations"),
    "age_by_encounter": with_views(AGE_AT_ENCOUNTER, "encounters", "patients"),
    "age_boxplot": with_views("""
        SELECT q.DESCRIPTION, CAST(q.n AS BIGINT) AS n, round(q.q1, 6) AS q1,
               round(q.median, 6) AS median, round(q.q3, 6) AS q3,
               round(min(CASE WHEN a.x BETWEEN f.lo_f AND f.hi_f THEN a.x END), 6) AS whisker_lo,
               round(max(CASE WHEN a.x BETWEEN f.lo_f AND f.hi_f THEN a.x END), 6) AS whisker_hi,
               CAST(count(CASE WHEN NOT (a.x BETWEEN f.lo_f AND f.hi_f) THEN 1 END) AS BIGINT)
                   AS n_outliers
        FROM (SELECT DESCRIPTION, CAST(age_at_encounter AS DOUBLE) AS x FROM aae) a
        JOIN q ON a.DESCRIPTION = q.DESCRIPTION
        JOIN (SELECT DESCRIPTION, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f
              FROM q) f ON a.DESCRIPTION = f.DESCRIPTION
        GROUP BY q.DESCRIPTION, q.n, q.q1, q.median, q.q3""",
        "encounters", "patients",
        extra={"aae": AGE_AT_ENCOUNTER,
               "q": """SELECT DESCRIPTION, count(*) AS n,
                              quantile_cont(CAST(age_at_encounter AS DOUBLE), 0.25) AS q1,
                              quantile_cont(CAST(age_at_encounter AS DOUBLE), 0.5) AS median,
                              quantile_cont(CAST(age_at_encounter AS DOUBLE), 0.75) AS q3
                       FROM aae GROUP BY DESCRIPTION"""}),
    "conditions_vs_encounters": with_views("SELECT * FROM cve", "conditions", "encounters",
                                           extra={"cve": COND_VS_ENC}),
}
EXPLORE["conditions_vs_encounters_pairs"] = with_views("""
    SELECT num_conditions, num_encounters, CAST(count(*) AS BIGINT) AS n_patients
    FROM cve GROUP BY num_conditions, num_encounters""", "conditions", "encounters",
    extra={"cve": COND_VS_ENC})


def _hist_query(views: tuple, extra: dict, src: str, col: str, bins: int) -> str:
    """with_views(...) for a histogram whose source needs extra CTEs first."""
    head = with_views("SELECT 1", *views, extra=extra)
    head = head[: head.rindex("SELECT 1")].rstrip()
    return head + hist_sql(src, col, bins)


EXPLORE["age_histogram"] = _hist_query(("patients",), {"demo": DEMOGRAPHICS},
                                       "SELECT age FROM demo", "age", 30)
EXPLORE["conditions_hist"] = _hist_query(
    ("conditions",), {"cpp": "SELECT PATIENT, count(*) AS n FROM conditions GROUP BY PATIENT"},
    "SELECT n FROM cpp", "n", 50)
EXPLORE["value_histogram"] = _hist_query(("observations",), {"nv": NUMERIC_VALUES},
                                         "SELECT value FROM nv", "value", 50)


# ---------------------------------------------------------------- metrics

from casebook.operators.metrics import FIXED_EDGES, N_BINS  # noqa: E402

PREFIX = "s"
CONDITION = "purchase"

PROCESSED = """
    SELECT sample_id, CAST(true_diagnosis AS VARCHAR) AS true_diagnosis,
           CAST(predicted_diagnosis AS VARCHAR) AS predicted_diagnosis, confidence, agent_used,
           CAST(true_diagnosis AS VARCHAR) = CAST(predicted_diagnosis AS VARCHAR) AS correct
    FROM predictions
    WHERE nullif(CAST(true_diagnosis AS VARCHAR), '') IS NOT NULL
      AND nullif(CAST(predicted_diagnosis AS VARCHAR), '') IS NOT NULL"""

RECORDS = """
    SELECT sample_id, predicted_diagnosis, true_diagnosis AS ground_truth, confidence
    FROM predictions"""

PER_CLASS = """
    SELECT coalesce(nt.label, np.label) AS label, coalesce(tp.tp, 0) AS tp,
           coalesce(nt.n_true, 0) AS n_true, coalesce(np.n_pred, 0) AS n_pred
    FROM (SELECT true_diagnosis AS label, count(*) AS n_true FROM ok GROUP BY 1) nt
    FULL OUTER JOIN (SELECT predicted_diagnosis AS label, count(*) AS n_pred FROM ok GROUP BY 1) np
      ON nt.label = np.label
    LEFT JOIN (SELECT true_diagnosis AS label, count(*) AS tp FROM ok
               WHERE true_diagnosis = predicted_diagnosis GROUP BY 1) tp
      ON tp.label = coalesce(nt.label, np.label)"""

CLS = """
    SELECT label, precision, recall,
           CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                ELSE 0.0 END AS f1, support
    FROM (SELECT label, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
                 CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END AS recall,
                 n_true AS support FROM pc) c"""

CLASS_REPORT = """
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM cls
    UNION ALL
    SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
           CAST(sum(support) AS BIGINT) FROM cls
    UNION ALL
    SELECT 'weighted avg',
           round(coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0), 6),
           round(coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0), 6),
           round(coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0), 6),
           CAST(sum(support) AS BIGINT) FROM cls"""

TOP_LABELS = """
    SELECT true_diagnosis AS label FROM ok WHERE true_diagnosis IS NOT NULL
    GROUP BY true_diagnosis ORDER BY count(*) DESC, true_diagnosis LIMIT 10"""

LATENCY = """
    SELECT operation, is_overall, round(coalesce(avg_ms, 0.0), 6) AS avg_ms,
           round(coalesce(min_ms, 0.0), 6) AS min_ms, round(coalesce(max_ms, 0.0), 6) AS max_ms,
           round(coalesce(p95_ms, 0.0), 6) AS p95_ms, CAST(count AS BIGINT) AS count
    FROM (SELECT operation, GROUPING(operation) = 1 AS is_overall,
                 avg(duration_ms) AS avg_ms, min(duration_ms) AS min_ms,
                 max(duration_ms) AS max_ms, quantile_cont(duration_ms, 0.95) AS p95_ms,
                 count(duration_ms) AS count
          FROM latencies GROUP BY GROUPING SETS ((operation), ())) g"""


def _dbl(v: float) -> str:
    return f"CAST('{v!r}' AS DOUBLE)"


_fixed_bin = " + ".join(f"(CASE WHEN confidence >= {_dbl(e)} THEN 1 ELSE 0 END)"
                        for e in FIXED_EDGES) + " - 1"
_fixed_centers = ", ".join(f"({i}, {_dbl((FIXED_EDGES[i] + FIXED_EDGES[i + 1]) / 2)})"
                           for i in range(N_BINS))
CALIBRATION_FIXED = f"""
    SELECT c.bin, round(c.bin_center, 6) AS bin_center, CAST(coalesce(a.n, 0) AS BIGINT) AS n,
           round(coalesce(a.acc, 0.0), 6) AS accuracy
    FROM (VALUES {_fixed_centers}) c(bin, bin_center)
    LEFT JOIN (SELECT bin, count(*) AS n, avg(CAST(correct AS DOUBLE)) AS acc
               FROM (SELECT {_fixed_bin} AS bin, correct FROM ok
                     WHERE NOT isnan(CAST(confidence AS DOUBLE))) b
               WHERE bin >= 0 AND bin < {N_BINS} GROUP BY bin) a ON a.bin = c.bin"""


def _edge(i: int) -> str:
    return "hi" if i == N_BINS else f"{i} * ((hi - lo) / {N_BINS}) + lo"


_adaptive_bin = " + ".join(f"(CASE WHEN x >= {_edge(i)} THEN 1 ELSE 0 END)"
                           for i in range(1, N_BINS))
_adaptive_centers = " UNION ALL ".join(
    f"SELECT {i} AS bin, ({_edge(i)} + {_edge(i + 1)}) / 2 AS bin_center FROM st"
    for i in range(N_BINS))
CALIBRATION_ADAPTIVE = f"""
    , v AS (SELECT coalesce(TRY_CAST(confidence AS DOUBLE), 0.0) AS x, correct FROM ok),
    st AS (SELECT CASE WHEN mn = mx THEN mn - 0.05 ELSE mn END AS lo,
                  CASE WHEN mn = mx THEN mn + 0.05 ELSE mx END AS hi
           FROM (SELECT min(x) AS mn, max(x) AS mx, count(*) AS cnt FROM v) s WHERE cnt > 10),
    b AS (SELECT {_adaptive_bin} AS bin, correct FROM v, st)
    SELECT b.bin, round(c.bin_center, 6) AS bin_center, CAST(count(*) AS BIGINT) AS n,
           round(avg(CAST(b.correct AS DOUBLE)), 6) AS accuracy
    FROM b JOIN ({_adaptive_centers}) c ON b.bin = c.bin
    GROUP BY b.bin, c.bin_center"""

CONFIDENCE_HIST = f"""
    , v AS (SELECT coalesce(TRY_CAST(confidence AS DOUBLE), 0.0) AS x, correct FROM ok),
    st AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                  CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi
           FROM (SELECT min(x) AS lo0, max(x) AS hi0 FROM v) s),
    b AS (SELECT correct,
                 least(CAST(floor((x - lo) * ({N_BINS} / (hi - lo))) AS INTEGER), {N_BINS - 1}) AS bin,
                 count(*) AS n
          FROM v, st GROUP BY 1, 2),
    grid AS (SELECT c.correct, CAST(r.range AS INTEGER) AS bin,
                    lo + (hi - lo) * CAST(r.range AS INTEGER) / {N_BINS} AS bin_lo,
                    lo + (hi - lo) * (CAST(r.range AS INTEGER) + 1) / {N_BINS} AS bin_hi
             FROM range({N_BINS}) r, (VALUES (true), (false)) c(correct), st)
    SELECT grid.correct, grid.bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi,
           CAST(coalesce(b.n, 0) AS BIGINT) AS n
    FROM grid LEFT JOIN b ON grid.bin = b.bin AND grid.correct = b.correct"""


def _with_ok(body: str, **extra) -> str:
    return with_views(body, "predictions", extra={"ok": PROCESSED, **extra})


def _cte_tail(body_with_leading_comma: str, **extra) -> str:
    head = _with_ok("SELECT 1", **extra)
    return head[: head.rindex("SELECT 1")].rstrip() + body_with_leading_comma


METRICS = {
    "prediction_rows": _with_ok("""
        SELECT CAST(row_number() OVER (ORDER BY sample_id) - 1 AS BIGINT) AS sample_index,
               sample_id, true_diagnosis, predicted_diagnosis, round(confidence, 6) AS confidence,
               agent_used, correct
        FROM ok"""),
    "run_summary": with_views("""
        SELECT CAST(count(*) AS BIGINT) AS total,
               CAST(count(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS processed,
               CAST(count(reason) AS BIGINT) AS skipped,
               CAST(count(*) FILTER (WHERE reason = 'missing_truth') AS BIGINT)
                   AS skipped_missing_truth,
               CAST(count(*) FILTER (WHERE reason = 'missing_prediction') AS BIGINT)
                   AS skipped_missing_prediction,
               CAST(count(*) FILTER (WHERE reason = 'missing_patient') AS BIGINT)
                   AS skipped_missing_patient,
               round(coalesce(sum(seconds) FILTER (WHERE reason IS NULL), 0), 6) AS total_seconds,
               round(coalesce(avg(seconds) FILTER (WHERE reason IS NULL), 0), 6) AS mean_seconds
        FROM (SELECT seconds, CASE WHEN patient IS NULL THEN 'missing_patient'
                          WHEN nullif(CAST(true_diagnosis AS VARCHAR), '') IS NULL
                               THEN 'missing_truth'
                          WHEN nullif(CAST(predicted_diagnosis AS VARCHAR), '') IS NULL
                               THEN 'missing_prediction' END AS reason
              FROM predictions) r""", "predictions"),
    "accuracy": with_views("""
        SELECT CAST(n_with_truth AS BIGINT) AS n_with_truth, CAST(n_correct AS BIGINT) AS n_correct,
               round(CASE WHEN n_with_truth > 0 THEN n_correct / n_with_truth ELSE 0.0 END, 6)
                   AS accuracy
        FROM (SELECT count(*) FILTER (WHERE ground_truth IS NOT NULL) AS n_with_truth,
                     count(*) FILTER (WHERE ground_truth IS NOT NULL AND ground_truth <> ''
                                      AND ground_truth = predicted_diagnosis) AS n_correct
              FROM rec) a""", "predictions", extra={"rec": RECORDS}),
    "prf_one_class": with_views(f"""
        SELECT '{CONDITION}' AS condition, round(p, 6) AS precision, round(r, 6) AS recall,
               round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1
        FROM (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
                     CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r
              FROM (SELECT
                      count(*) FILTER (WHERE predicted_diagnosis IS NOT DISTINCT FROM '{CONDITION}'
                                         AND ground_truth = '{CONDITION}') AS tp,
                      count(*) FILTER (WHERE predicted_diagnosis IS NOT DISTINCT FROM '{CONDITION}'
                                         AND ground_truth <> '{CONDITION}') AS fp,
                      count(*) FILTER (WHERE predicted_diagnosis IS DISTINCT FROM '{CONDITION}'
                                         AND ground_truth = '{CONDITION}') AS fn
                    FROM rec WHERE ground_truth IS NOT NULL) c) s""",
        "predictions", extra={"rec": RECORDS}),
    "class_report": _with_ok(CLASS_REPORT, pc=PER_CLASS, cls=CLS),
    "averaged_f1": _with_ok("""
        SELECT CAST(a.n AS BIGINT) AS n, round(CASE WHEN a.n > 0 THEN a.c / a.n ELSE 0.0 END, 6)
                   AS accuracy,
               w.precision AS precision_weighted, w.recall AS recall_weighted,
               w.f1 AS f1_weighted, m.f1 AS f1_macro
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE true_diagnosis = predicted_diagnosis)
                     AS c FROM ok) a,
             (SELECT * FROM rep WHERE label = 'weighted avg') w,
             (SELECT * FROM rep WHERE label = 'macro avg') m""",
        pc=PER_CLASS, cls=CLS, rep=CLASS_REPORT),
    "confusion_matrix": _with_ok("""
        SELECT true_diagnosis AS actual, predicted_diagnosis AS predicted, CAST(count(*) AS BIGINT) AS n
        FROM ok WHERE true_diagnosis IS NOT NULL AND predicted_diagnosis IS NOT NULL GROUP BY 1, 2"""),
    "confusion_many": """
        SELECT p_brand || '/' || p_size AS actual,
               p_brand || '/' || (p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS predicted,
               CAST(count(*) AS BIGINT) AS n
        FROM part WHERE p_partkey % 11 > 0 GROUP BY 1, 2""",
    "confusion_grid": _with_ok("""
        SELECT a.label AS actual, p.label AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
        FROM labs a CROSS JOIN labs p
        LEFT JOIN (SELECT true_diagnosis, predicted_diagnosis, count(*) AS n FROM ok
                   GROUP BY 1, 2) c
          ON c.true_diagnosis = a.label AND c.predicted_diagnosis = p.label""",
        labs=TOP_LABELS),
    "latency_report": with_views(LATENCY, "latencies"),
    "agent_usage": _with_ok("SELECT agent_used, CAST(count(*) AS BIGINT) AS n FROM ok "
                            "GROUP BY agent_used"),
    "agent_accuracy": _with_ok("""
        SELECT agent_used, CAST(count(*) FILTER (WHERE correct) AS BIGINT) AS n_correct,
               CAST(count(*) AS BIGINT) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy
        FROM ok GROUP BY agent_used"""),
    "calibration_fixed": _with_ok(CALIBRATION_FIXED),
    "calibration_adaptive": _cte_tail(CALIBRATION_ADAPTIVE),
    "confidence_hist": _cte_tail(CONFIDENCE_HIST),
    "prefix_filtered_eval": with_views(f"""
        SELECT sample_id, true_diagnosis, predicted_diagnosis FROM predictions
        WHERE coalesce(nullif(CAST(true_diagnosis AS VARCHAR), ''), NULL) IS NOT NULL
          AND starts_with(CAST(true_diagnosis AS VARCHAR), '{PREFIX}')""", "predictions"),
}

METRICS["metrics_report"] = with_views(f"""
    SELECT section, name, metric, round(value, 6) AS value FROM (
      SELECT 'overall' AS section, '' AS name, 'accuracy' AS metric,
             CAST(accuracy AS DOUBLE) AS value FROM acc
      UNION ALL
      SELECT 'overall', '', 'total_diagnoses', CAST(count(*) AS DOUBLE) FROM rec
      UNION ALL
      SELECT CASE WHEN is_overall THEN 'latency' ELSE 'operation' END,
             coalesce(operation, ''), m.metric,
             CASE m.metric WHEN 'avg_ms' THEN avg_ms WHEN 'min_ms' THEN min_ms
                           WHEN 'max_ms' THEN max_ms WHEN 'p95_ms' THEN p95_ms
                           ELSE CAST(count AS DOUBLE) END
      FROM lat, (VALUES ('avg_ms'), ('min_ms'), ('max_ms'), ('p95_ms'), ('count')) m(metric)
      UNION ALL
      SELECT 'condition', l.label, m.metric,
             CASE m.metric WHEN 'precision' THEN p WHEN 'recall' THEN r
                  ELSE CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END END
      FROM (SELECT labs.label,
                   CASE WHEN coalesce(n_pred, 0) > 0 THEN coalesce(tp, 0) / n_pred ELSE 0.0 END AS p,
                   CASE WHEN coalesce(n_true, 0) > 0 THEN coalesce(tp, 0) / n_true ELSE 0.0 END AS r
            FROM labs LEFT JOIN pcr ON labs.label = pcr.label) l,
           (VALUES ('precision'), ('recall'), ('f1')) m(metric)
      UNION ALL
      SELECT 'confusion', ground_truth || ' -> ' || predicted_diagnosis, 'count', CAST(count(*) AS DOUBLE)
      FROM rec WHERE ground_truth IN (SELECT label FROM labs) AND predicted_diagnosis IN (SELECT label FROM labs)
      GROUP BY ground_truth, predicted_diagnosis
    ) u""", "predictions", "latencies", extra={
    "ok": PROCESSED, "rec": RECORDS,
    "labs": """SELECT DISTINCT label FROM (SELECT true_diagnosis AS label FROM ok
                                          UNION ALL SELECT predicted_diagnosis FROM ok) t
               WHERE label IS NOT NULL""",
    "acc": """SELECT CASE WHEN count(*) FILTER (WHERE ground_truth IS NOT NULL) > 0
                     THEN count(*) FILTER (WHERE ground_truth IS NOT NULL AND ground_truth <> ''
                                           AND ground_truth = predicted_diagnosis)
                          / count(*) FILTER (WHERE ground_truth IS NOT NULL)
                     ELSE 0.0 END AS accuracy FROM rec""",
    "lat": LATENCY,
    "pcr": """
        SELECT coalesce(nt.label, np.label) AS label, tp.tp, nt.n_true, np.n_pred
        FROM (SELECT ground_truth AS label, count(*) AS n_true FROM rec
              WHERE ground_truth IS NOT NULL GROUP BY 1) nt
        FULL OUTER JOIN (SELECT predicted_diagnosis AS label, count(*) AS n_pred FROM rec
                         WHERE ground_truth IS NOT NULL GROUP BY 1) np ON nt.label = np.label
        LEFT JOIN (SELECT ground_truth AS label, count(*) AS tp FROM rec
                   WHERE ground_truth = predicted_diagnosis GROUP BY 1) tp
          ON tp.label = coalesce(nt.label, np.label)"""})


# ---------------------------------------------------------------- routing / voting / parsing

from casebook.operators.routing import DEFAULT_ROUTES, quote, usable  # noqa: E402

STRIP = "regexp_replace({x}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x=x)


def _route_list(text: str) -> str:
    hits = []
    for d in usable(DEFAULT_ROUTES):
        if not d.agent_id:
            continue
        alts = "|".join(quote(k) for k in d.keywords if k)
        pat = f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({alts})($|[^\\p{{L}}\\p{{N}}_])"
        hits.append(f"CASE WHEN regexp_matches({text}, '{pat}') THEN '{d.agent_id}' END")
    return f"list_sort(list_distinct(list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL)))"


ROUTED = f"SELECT note_id, text, {_route_list('text')} AS agents FROM notes"

FANOUT = """
    SELECT a.case_id, a.agent_id, a.diagnosis, a.confidence, a.seq1, a.seq2, a.seq3
    FROM (SELECT note_id AS case_id, unnest(agents) AS agent_id FROM routed) r
    JOIN agent_answers a ON a.case_id = r.case_id AND a.agent_id = r.agent_id"""


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, 1.0))"


def _vote_ctes(src: str, temp: float = 1.0) -> dict:
    return {
        "va": f"""SELECT case_id, diagnosis, {_clamp('confidence')} AS conf,
                         dense_rank() OVER (PARTITION BY case_id ORDER BY seq1, seq2, seq3) AS seq
                  FROM {src}""",
        "vp": """SELECT case_id, diagnosis, count(*) AS n_votes, round(avg(conf), 9) AS avg_c,
                        median(conf) AS med_c, min(seq) AS first_seen
                 FROM va GROUP BY case_id, diagnosis""",
        "vs": f"""SELECT *, e / sum(e) OVER (PARTITION BY case_id) AS score FROM (
                    SELECT *, exp(avg_c / {temp!r} - max(avg_c / {temp!r}) OVER (PARTITION BY case_id))
                              AS e FROM vp) t""",
        "vm": "SELECT *, n_votes / sum(n_votes) OVER (PARTITION BY case_id) AS score FROM vp",
    }


def _winner(cte: str) -> str:
    return f"""
        SELECT case_id, diagnosis, score FROM (
          SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, med_c DESC,
                                       first_seen ASC, diagnosis ASC) AS rn FROM {cte}) w
        WHERE rn = 1"""


CAND = f"""
    SELECT case_id, agent_id, diagnosis AS answer, {_clamp('confidence')} AS confidence,
           seq1, seq2, seq3 FROM fanout"""

_BLOCK = ("'[' || agent_id || ']' || CASE WHEN confidence IS NULL THEN '' "
          "ELSE ' (confidence=' || printf('%.2f', confidence) || ')' END || ':' || chr(10) || "
          + _strip("answer") + " || chr(10)")

_SEC_PAT = "(?im)^\\s*{label}:[ \\t]*(.*?)\\s*$"


def _section(label: str) -> str:
    return f"nullif(regexp_extract(answer, '{_SEC_PAT.format(label=label)}', 1), '')"


VIEW_SQL.update({
    "refined_outputs": """
        SELECT case_id, line,
               CASE line WHEN 4 THEN CAST(json_object('diagnosis', rf, 'confidence', conf)
                                          AS VARCHAR)
                         WHEN 5 THEN CAST(json_object('diagnosis', rf, 'reasoning', rs,
                                                      'confidence', conf, 'agent', line) AS VARCHAR)
                         WHEN 6 THEN CAST(json_object('diagnosis', rf, 'reasoning', rs,
                                                      'confidence', 'high') AS VARCHAR)
                         WHEN 7 THEN substr(CAST(json_object('diagnosis', rf, 'reasoning', rs,
                                                             'confidence', conf) AS VARCHAR), 1, 12)
                         ELSE CAST(json_object('diagnosis', rf, 'reasoning', rs, 'confidence', conf)
                                   AS VARCHAR) END AS raw
        FROM (SELECT l_orderkey AS case_id, l_linenumber AS line, l_returnflag AS rf,
                     'status ' || l_linestatus AS rs, l_discount * 12 - 0.1 AS conf
              FROM lineitem) s""",
    "delimited_lines": """
        SELECT l_orderkey AS case_id, l_partkey AS part,
               CASE l_linenumber
                 WHEN 7 THEN CAST(l_linenumber AS VARCHAR) || '::' || l_returnflag
                 WHEN 6 THEN CAST(l_linenumber AS VARCHAR) || '::' || l_returnflag || '::n/a'
                 ELSE CAST(l_linenumber AS VARCHAR) || '::' || l_returnflag || '::'
                      || CAST(l_discount * 12 - 0.1 AS VARCHAR) END AS line
        FROM lineitem""",
    "sectioned_answers": """
        SELECT l_orderkey AS case_id, l_linenumber AS line, l_partkey AS part,
               'Primary Diagnosis: ' || l_returnflag || chr(10) || 'Secondary Diagnoses: '
               || CASE WHEN l_linestatus = 'O' THEN 'None'
                       ELSE l_linestatus || ', ' || l_returnflag END
               || chr(10) || 'Rationale: line ' || CAST(l_linenumber AS VARCHAR) AS answer
        FROM lineitem""",
})

_R = {"routed": ROUTED}
_RF = {"routed": ROUTED, "fanout": FANOUT}

VOTING = {
    "route_notes": with_views("""
        SELECT note_id, array_to_string(agents, ',') AS agents, CAST(len(agents) AS BIGINT) AS n_agents
        FROM routed""", "notes", extra=_R),
    "route_phrases": with_views("""
        SELECT n.note_id, coalesce(string_agg(DISTINCT k.agent, ',' ORDER BY k.agent), '') AS agents
        FROM (SELECT note_id, ' ' || text || ' ' AS text FROM notes) n
        LEFT JOIN (SELECT 'agent' || (item_id % 7) AS agent,
                          array_to_string(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')[1:2], ' ') AS phrase
                   FROM benchmark) k
          ON contains(lower(n.text), lower(k.phrase)) AND regexp_matches(n.text, '(?i)[^\\p{L}\\p{N}_]'
             || regexp_escape(k.phrase) || '[^\\p{L}\\p{N}_]')
        GROUP BY n.note_id""", "notes"),
    "route_summary": with_views("""
        SELECT label, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT unnest(agents) AS label FROM routed) u GROUP BY label
        UNION ALL SELECT 'multi_routed', CAST(count(*) FILTER (WHERE len(agents) > 1) AS BIGINT)
                  FROM routed
        UNION ALL SELECT 'unrouted', CAST(count(*) FILTER (WHERE len(agents) = 0) AS BIGINT)
                  FROM routed""", "notes", extra=_R),
    "route_fanout": with_views("""
        SELECT case_id, agent_id, diagnosis, round(confidence, 6) AS confidence FROM fanout""",
        "notes", "agent_answers", extra=_RF),
    "vote_softmax": with_views("SELECT case_id, diagnosis, round(score, 6) AS score FROM win",
                               "agent_answers",
                               extra={**_vote_ctes("agent_answers"), "win": _winner("vs")}),
    "vote_majority": with_views("SELECT case_id, diagnosis, round(score, 6) AS score FROM win",
                                "agent_answers",
                                extra={**_vote_ctes("agent_answers"), "win": _winner("vm")}),
    "vote_scores": with_views("""
        SELECT vs.case_id, vs.diagnosis, CAST(vs.n_votes AS BIGINT) AS n_votes,
               round(vs.avg_c, 6) AS avg_confidence, round(vs.med_c, 6) AS median_confidence,
               round(vs.score, 6) AS softmax_score, round(vm.score, 6) AS majority_score
        FROM vs JOIN vm ON vs.case_id = vm.case_id AND vs.diagnosis = vm.diagnosis""",
        "agent_answers", extra=_vote_ctes("agent_answers")),
    "case_pipeline": with_views("""
        SELECT s.case_id, s.diagnosis AS softmax_diagnosis, round(s.score, 6) AS softmax_score,
               m.diagnosis AS majority_diagnosis, round(m.score, 6) AS majority_score
        FROM ws s JOIN wm m ON s.case_id = m.case_id""",
        "notes", "agent_answers",
        extra={**_RF, **_vote_ctes("fanout"), "ws": _winner("vs"), "wm": _winner("vm")}),
    "refine_prompt": with_views(f"""
        SELECT n.note_id AS case_id,
               'USER CASE:' || chr(10) || {_strip('n.text')} || chr(10) || chr(10)
               || 'CANDIDATE ANSWERS:' || chr(10) || b.blocks || chr(10) AS prompt
        FROM notes n
        JOIN (SELECT case_id, string_agg(blk, chr(10) ORDER BY agent_id, seq1, seq2, seq3, blk)
                                 AS blocks
              FROM (SELECT *, {_BLOCK} AS blk FROM cand) c GROUP BY case_id) b
          ON n.note_id = b.case_id""", "notes", "agent_answers", extra={**_RF, "cand": CAND}),
    "refine_numbered": with_views(f"""
        SELECT n.note_id AS case_id,
               'Patient Prompt:' || chr(10) || {_strip('n.text')} || chr(10) || chr(10)
               || 'Agent Diagnoses:' || chr(10) || b.items AS prompt
        FROM notes n
        JOIN (SELECT case_id, string_agg(item, chr(10) ORDER BY rn) AS items
              FROM (SELECT case_id,
                           row_number() OVER (PARTITION BY case_id
                                              ORDER BY agent_id, seq1, seq2, seq3, answer,
                                                       confidence) AS rn,
                           CAST(row_number() OVER (PARTITION BY case_id
                                                   ORDER BY agent_id, seq1, seq2, seq3, answer,
                                                            confidence) AS VARCHAR)
                           || '. Agent: ' || agent_id || ', Diagnosis: ' || answer
                           || ', Confidence: '
                           || CASE WHEN confidence IS NULL THEN 'N/A'
                                   ELSE printf('%.2f', confidence) END AS item
                    FROM cand) c GROUP BY case_id) b
          ON n.note_id = b.case_id""", "notes", "agent_answers", extra={**_RF, "cand": CAND}),
    "refine_parse": with_views(f"""
        SELECT case_id, line, reject_reason, reject_reason IS NULL AS ok,
               CASE WHEN reject_reason IS NULL THEN json_extract_string(raw, '$.diagnosis') END
                   AS diagnosis,
               CASE WHEN reject_reason IS NULL THEN json_extract_string(raw, '$.reasoning') END
                   AS reasoning,
               CASE WHEN reject_reason IS NULL THEN round({_clamp(
                   "TRY_CAST(json_extract_string(raw, '$.confidence') AS DOUBLE)")}, 6) END
                   AS confidence
        FROM (SELECT *, CASE
                WHEN NOT coalesce(json_valid(raw), false) THEN 'not_a_json_object'
                WHEN json_type(raw) <> 'OBJECT' THEN 'not_a_json_object'
                WHEN list_sort(json_keys(raw)) <> ['confidence', 'diagnosis', 'reasoning']
                     THEN 'wrong_keys'
                WHEN TRY_CAST(json_extract_string(raw, '$.confidence') AS DOUBLE) IS NULL
                     THEN 'bad_confidence' END AS reject_reason
              FROM refined_outputs) r""", "refined_outputs"),
    "sectioned_answer": with_views(f"""
        SELECT case_id, line, part, primary_dx AS "primary",
               array_to_string(secondary, ',') AS secondary,
               CAST(len(secondary) AS BIGINT) AS n_secondary, rationale
        FROM (SELECT case_id, line, part, {_section('Primary Diagnosis')} AS primary_dx,
                     CASE WHEN sec IS NULL OR lower(sec) = 'none' THEN []
                          ELSE list_filter(list_transform(string_split_regex(sec, '[,;]'),
                                                          lambda x: trim(x)), lambda x: x <> '') END
                         AS secondary,
                     {_section('Rationale')} AS rationale
              FROM (SELECT *, {_section('Secondary Diagnoses')} AS sec FROM sectioned_answers) a) b""",
        "sectioned_answers"),
    "delimited_answers": with_views(f"""
        SELECT case_id, part, reject_reason, reject_reason IS NULL AS ok,
               CASE WHEN reject_reason IS NULL THEN parts[1] END AS agent_id,
               CASE WHEN reject_reason IS NULL THEN parts[2] END AS diagnosis,
               CASE WHEN reject_reason IS NULL THEN round({_clamp('conf')}, 6) END AS confidence
        FROM (SELECT *, CASE WHEN len(parts) <> 3 THEN 'wrong_field_count'
                             WHEN conf IS NULL THEN 'bad_confidence' END AS reject_reason
              FROM (SELECT *, CASE WHEN len(parts) = 3
                                   THEN TRY_CAST(trim(parts[3]) AS DOUBLE) END AS conf
                    FROM (SELECT case_id, part, string_split({_strip('line')}, '::') AS parts
                          FROM delimited_lines) s) t) u""", "delimited_lines"),
}


# ---------------------------------------------------------------- domains, splits, eval slice

from casebook.sources.views import DOMAIN_MAX_SIZE  # noqa: E402


def _hash(key: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


VIEW_SQL.update({
    "domain_map": f"""
        SELECT CAST(p_partkey AS VARCHAR) AS code, lower(p_type) AS domain FROM part
        WHERE p_size <= {DOMAIN_MAX_SIZE}""",
    "labelled_docs": """
        SELECT d.doc_id, d.text, CAST(l.quality AS VARCHAR) AS label
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
})

DOMAIN_SAMPLES = """
    SELECT patient_id, label, 'general' AS domain FROM samples
    UNION ALL
    SELECT s.patient_id, s.label, m.domain FROM samples s
    JOIN domain_map m ON CAST(s.label AS VARCHAR) = m.code
    WHERE s.label IS NOT NULL AND m.domain <> 'general'"""


def _corpus_with(body: str, *more_views: str, **extra) -> str:
    return with_views(body, "conditions", "patients", *more_views,
                      extra={**_corpus_sql(True), **extra})


def _strip_sql(x: str) -> str:
    return STRIP.format(x=x)


LAST_CONDITION = """
    SELECT PATIENT, START, STOP, CODE, DESCRIPTION FROM (
      SELECT *, row_number() OVER (PARTITION BY PATIENT
                                   ORDER BY STOP IS NULL DESC, STOP DESC NULLS LAST,
                                            START DESC NULLS LAST, CODE DESC NULLS LAST,
                                            DESCRIPTION DESC NULLS LAST) AS rn
      FROM conditions WHERE PATIENT IS NOT NULL) t
    WHERE rn = 1"""

EVAL_SLICE = """
    SELECT patient_id, age, gender, icd10_code, icd10_text,
           'Patient ' || upper(substr(gender, 1, 1)) || lower(substr(gender, 2)) || ', age '
           || CAST(age AS VARCHAR)
           || '. Presenting with medical history culminating in diagnosis: '
           || lower(icd10_text) || '.' AS vignette,
           CASE WHEN starts_with(icd10_code, 'I') THEN 'Cardiology'
                WHEN starts_with(icd10_code, 'E') THEN 'Metabolic' ELSE 'General' END AS domain
    FROM (SELECT p.ID AS patient_id,
                 CAST(coalesce(2025 - TRY_CAST(substr(CAST(p.BIRTHDATE AS VARCHAR), 1, 4) AS INTEGER),
                               -1) AS INTEGER) AS age,
                 p.GENDER AS gender, CAST(lc.CODE AS VARCHAR) AS icd10_code,
                 lc.DESCRIPTION AS icd10_text
          FROM patients p JOIN lc ON p.ID = lc.PATIENT) s"""

SLICE_COLS = "patient_id, age, gender, icd10_code, icd10_text, vignette, domain"
SAMPLE_N = 500

SPLITS = {
    "domain_corpus": _corpus_with("SELECT patient_id, label, domain FROM ds", "domain_map",
                                  ds=DOMAIN_SAMPLES),
    "domain_stats": _corpus_with("""
        SELECT domain, CAST(total AS BIGINT) AS total,
               CAST(CASE WHEN total > 10 OR domain = 'general'
                         THEN floor(total * CAST(0.8 AS DOUBLE)) ELSE 0 END
                    AS BIGINT) AS train,
               CAST(CASE WHEN total > 10 OR domain = 'general'
                         THEN total - floor(total * CAST(0.8 AS DOUBLE)) ELSE 0 END
                    AS BIGINT) AS test
        FROM (SELECT domain, count(*) AS total FROM ds GROUP BY domain) c""", "domain_map",
        ds=DOMAIN_SAMPLES),
    "corpus_split": _corpus_with(f"""
        SELECT h.patient_id, h.label, h.domain,
               CASE WHEN row_number() OVER (PARTITION BY h.domain ORDER BY h.h, h.patient_id) - 1
                         < floor(nn.n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, {_hash('patient_id')} AS h FROM ds) h
        JOIN (SELECT domain, count(*) AS n FROM ds GROUP BY domain
              HAVING count(*) > 10 OR domain = 'general') nn
          ON h.domain = nn.domain""", "domain_map", ds=DOMAIN_SAMPLES),
    "stratified_split": with_views(f"""
        SELECT s.doc_id, s.label,
               CASE WHEN row_number() OVER (PARTITION BY s.stratum ORDER BY s.h, s.doc_id) - 1
                         < floor(nn.n * CAST(0.75 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
        FROM s JOIN (SELECT stratum, count(*) AS n FROM s GROUP BY stratum) nn
          ON s.stratum = nn.stratum""", "labelled_docs", extra={
        "s": f"""SELECT doc_id, label, {_hash('doc_id')} AS h,
                        CASE WHEN (SELECT min(c) FROM (SELECT label, count(*) AS c
                                                       FROM labelled_docs GROUP BY label) x) >= 2
                             THEN label ELSE '*' END AS stratum
                 FROM labelled_docs"""}),
    "sample_examples": _corpus_with(f"""
        SELECT patient_id, label FROM samples ORDER BY {_hash('patient_id')}, patient_id LIMIT 5"""),
    "prompt_expected_split": _corpus_with(f"""
        SELECT patient_id, {_strip_sql('substr(text, 1, cut)')} AS prompt,
               {_strip_sql('substr(text, cut + 1)')} AS expected
        FROM (SELECT *, CASE WHEN instr(text, chr(10) || 'AI:') > 0
                             THEN instr(text, chr(10) || 'AI:') - 1
                             ELSE CAST(floor(length(text) / 2) AS INTEGER) END AS cut
              FROM samples) s"""),
    "eval_slice_last_condition": with_views(f"SELECT {SLICE_COLS} FROM sl", "patients",
                                            "conditions",
                                            extra={"lc": LAST_CONDITION, "sl": EVAL_SLICE}),
    "eval_slice_meta": with_views("""
        SELECT CAST(count(*) AS BIGINT) AS n_rows,
               CAST(count(DISTINCT icd10_code) AS BIGINT) AS n_unique_codes,
               CAST(42 AS INTEGER) AS generation_seed FROM sl""", "patients", "conditions",
        extra={"lc": LAST_CONDITION, "sl": EVAL_SLICE}),
    "eval_slice_sample": with_views(f"""
        SELECT {SLICE_COLS} FROM sampled WHERE (SELECT count(*) FROM sl) > {SAMPLE_N}
        UNION ALL
        SELECT {SLICE_COLS} FROM sl WHERE (SELECT count(*) FROM sl) <= {SAMPLE_N}""",
        "patients", "conditions", extra={
            "lc": LAST_CONDITION, "sl": EVAL_SLICE,
            "hs": f"SELECT *, {_hash('patient_id')} AS h FROM sl",
            "capped": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY icd10_code
                                                                   ORDER BY h, patient_id) AS r
                                        FROM hs) t WHERE r <= {max(1, SAMPLE_N // 50)}""",
            "sampled": f"SELECT * FROM capped ORDER BY h, patient_id LIMIT {SAMPLE_N}"}),
}


# ---------------------------------------------------------------- validation (V1–V4)

from casebook.operators.validate import (EMERGENCY_SYMPTOMS, VALID_ETHNICITIES,  # noqa: E402
                                         VALID_GENDERS, VALID_RACES)
from casebook.sources.patient_json import record_sql  # noqa: E402

_DOB = "(\\d{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\\d|0[1-9]|[1-9])"
_ICD = "[A-Z]\\d\\d(\\.\\d{1,2})?"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _t(path: str, j: str = "j") -> str:
    return f"json_type({j}, '{path}')"


def _txt(path: str, j: str = "j") -> str:
    return (f"CASE {_t(path, j)} WHEN 'VARCHAR' THEN json_extract_string({j}, '{path}') "
            f"WHEN 'NULL' THEN 'None' ELSE CAST(json_extract({j}, '{path}') AS VARCHAR) END")


def _elems(name: str) -> str:
    return (f"CASE WHEN {_t('$.' + name)} = 'ARRAY' THEN json_extract(j, '$.{name}[*]') "
            f"ELSE CAST([] AS JSON[]) END")


def _err_sql(cond: str, code: str, msg: str) -> str:
    return f"CASE WHEN {cond} THEN {{'code': '{code}', 'message': {msg}}} END"


_AGE_I = """CASE json_type(j, '$.age')
      WHEN 'BIGINT' THEN TRY_CAST(json_extract_string(j, '$.age') AS INTEGER)
      WHEN 'UBIGINT' THEN TRY_CAST(json_extract_string(j, '$.age') AS INTEGER)
      WHEN 'DOUBLE' THEN TRY_CAST(trunc(CAST(json_extract_string(j, '$.age') AS DOUBLE)) AS INTEGER)
      WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(json_extract_string(j, '$.age')),
                                                      '[+-]?[0-9]+')
                               THEN TRY_CAST(trim(json_extract_string(j, '$.age')) AS INTEGER) END
      WHEN 'BOOLEAN' THEN CASE json_extract_string(j, '$.age') WHEN 'true' THEN 1 ELSE 0 END
    END"""


def _enum_err(name: str, valid: list[str], label: str) -> str:
    lst = ", ".join(_q(v) for v in valid)
    low = f"lower(json_extract_string(j, '$.{name}'))"
    shown = f"CASE WHEN {_t('$.' + name)} = 'VARCHAR' THEN {low} ELSE {_txt('$.' + name)} END"
    cond = (f"{_t('$.' + name)} IS NOT NULL AND ({_t('$.' + name)} <> 'VARCHAR' "
            f"OR {low} NOT IN ({lst}))")
    msg = f"'{label} ''' || {shown} || ''' is not valid. Must be one of: {', '.join(valid)}'"
    return _err_sql(cond, f"{name}_invalid", msg)


def _dob_valid(s: str) -> str:
    return (f"(regexp_full_match({s}, '{_DOB}') AND TRY_CAST("
            f"regexp_extract({s}, '^{_DOB}$', 1) || '-' || lpad(regexp_extract({s}, '^{_DOB}$', 2), 2, '0')"
            f" || '-' || lpad(regexp_extract({s}, '^{_DOB}$', 3), 2, '0') AS DATE) IS NOT NULL)")


def _item_errs(name: str, prefix: str, not_list: str, not_dict: str, key: str, who: str) -> str:
    head = _err_sql(f"{_t('$.' + name)} IS NOT NULL AND {_t('$.' + name)} <> 'ARRAY'",
                    f"{prefix}_not_list", _q(not_list))
    x_txt = ("CASE json_type(x) WHEN 'VARCHAR' THEN json_extract_string(x, '$') "
             "WHEN 'NULL' THEN 'None' ELSE CAST(x AS VARCHAR) END")
    item = (f"lambda x: CASE WHEN json_type(x) <> 'OBJECT' THEN "
            f"{{'code': '{prefix}_item_not_dict', 'message': {_q(not_dict)} || {x_txt}}} "
            f"WHEN json_type(x, '$.{key}') IS NULL THEN "
            f"{{'code': '{prefix}_item_missing_{key}', 'message': "
            f"{_q(who + ' missing ' + chr(39) + key + chr(39) + ': ')} || {x_txt}}} END")
    return f"[{head}] || list_transform({_elems(name)}, {item})"


_STRIP_X = STRIP.format(x="json_extract_string(x, '$')")
_X_TXT = ("CASE json_type(x) WHEN 'VARCHAR' THEN json_extract_string(x, '$') "
          "WHEN 'NULL' THEN 'None' ELSE CAST(x AS VARCHAR) END")

_ERRORS = " || ".join([
    "[" + ", ".join(
        [_err_sql(f"{_t('$.' + f)} IS NULL", f"missing_{f}", _q(f"Required field '{f}' is missing"))
         for f in ("age", "gender", "symptoms")]
        + [_err_sql(f"{_t('$.age')} IS NOT NULL AND age_i IS NULL", "age_not_a_number",
                    f"'Age ''' || {_txt('$.age')} || ''' is not a valid number'"),
           _err_sql("age_i < 0 OR age_i > 120", "age_out_of_range",
                    "'Age ' || CAST(age_i AS VARCHAR) || ' is outside valid range (0-120)'"),
           _enum_err("gender", VALID_GENDERS, "Gender"),
           _enum_err("ethnicity", VALID_ETHNICITIES, "Ethnicity"),
           _enum_err("race", VALID_RACES, "Race"),
           _err_sql(f"{_t('$.symptoms')} IS NOT NULL AND {_t('$.symptoms')} <> 'ARRAY'",
                    "symptoms_not_list", "'Symptoms must be a list'"),
           _err_sql(f"{_t('$.symptoms')} = 'ARRAY' AND len({_elems('symptoms')}) = 0",
                    "symptoms_empty", "'At least one symptom must be provided'")]) + "]",
    f"""list_transform({_elems('symptoms')}, lambda x: CASE
          WHEN json_type(x) <> 'VARCHAR' OR {_STRIP_X} = ''
          THEN {{'code': 'symptom_invalid', 'message': 'Invalid symptom: ''' || {_X_TXT} || ''''}} END)""",
    "[" + _err_sql(f"{_t('$.icd10')} IS NOT NULL AND {_t('$.icd10')} <> 'ARRAY'", "icd10_not_list",
                   _q("Input field 'icd10' must be a list")) + "]",
    f"""list_transform({_elems('icd10')}, lambda x: CASE
          WHEN json_type(x) <> 'VARCHAR' OR NOT regexp_full_match(json_extract_string(x, '$'), '{_ICD}')
          THEN {{'code': 'icd10_invalid', 'message':
                 'Invalid ICD-10 code format in input field ''icd10'': ''' || {_X_TXT} || ''''}} END)""",
    "[" + _err_sql(f"{_t('$.dob')} IS NOT NULL AND NOT coalesce({_t('$.dob')} = 'VARCHAR' AND "
                   f"{_dob_valid(chr(106) + 's_dob')}, false)".replace("js_dob", "s_dob"),
                   "dob_invalid",
                   f"'Invalid date of birth format: ''' || {_txt('$.dob')} || '''. Use YYYY-MM-DD format.'")
    + "]",
    _item_errs("medical_history", "history", "Medical history must be a list",
               "Medical history item must be a dictionary: ", "condition", "Medical history item"),
    _item_errs("medications", "medication", "Medications must be a list",
               "Medication must be a dictionary: ", "name", "Medication"),
])

VALIDATED = f"""
    SELECT record_id, j, list_filter({_ERRORS}, lambda e: e IS NOT NULL) AS errs
    FROM (SELECT record_id, record AS j, json_extract_string(record, '$.dob') AS s_dob,
                 {_AGE_I} AS age_i
          FROM recs) r"""

_SYM_CLEAN = (f"list_filter(list_transform(list_filter({_elems('symptoms')}, "
              f"lambda x: json_type(x) = 'VARCHAR'), lambda x: lower({_STRIP_X})), lambda s: s <> '')")
_ICD_CLEAN = (f"list_transform(list_filter({_elems('icd10')}, lambda x: json_type(x) = 'VARCHAR' "
              f"AND regexp_full_match(json_extract_string(x, '$'), '{_ICD}')), "
              f"lambda x: json_extract_string(x, '$'))")
_MED_CLEAN = (f"list_filter({_elems('medications')}, lambda x: json_type(x) = 'OBJECT' "
              f"AND json_type(x, '$.name') IS NOT NULL)")


def _enum_clean(name: str, valid: list[str]) -> str:
    lst = ", ".join(_q(v) for v in valid)
    low = f"lower(json_extract_string(j, '$.{name}'))"
    return (f"CASE WHEN {_t('$.' + name)} IS NULL THEN NULL "
            f"WHEN {_t('$.' + name)} = 'VARCHAR' AND {low} IN ({lst}) THEN {low} ELSE 'unknown' END")


_LOWERED = (f"list_transform(list_filter({_elems('symptoms')}, lambda x: json_type(x) = 'VARCHAR'), "
            f"lambda x: lower(json_extract_string(x, '$')))")
_PHRASES = "[" + ", ".join(_q(p) for p in EMERGENCY_SYMPTOMS) + "]"

_REC = {"recs": record_sql()}

VALIDATION = {
    "validate_records": with_views("""
        SELECT record_id, len(errs) = 0 AS is_valid, CAST(len(errs) AS BIGINT) AS n_errors,
               array_to_string(list_transform(errs, lambda e: e.code), ',') AS error_codes,
               array_to_string(list_transform(errs, lambda e: e.message), ' | ') AS messages
        FROM v""", "patients", extra={**_REC, "v": VALIDATED}),
    "validation_report": with_views("""
        SELECT 'valid' AS metric, CAST(count(*) FILTER (WHERE len(errs) = 0) AS BIGINT) AS n FROM v
        UNION ALL
        SELECT 'invalid', CAST(count(*) FILTER (WHERE len(errs) > 0) AS BIGINT) FROM v
        UNION ALL
        SELECT e.code, CAST(count(*) AS BIGINT) FROM (SELECT unnest(errs) AS e FROM v) u
        GROUP BY e.code""", "patients", extra={**_REC, "v": VALIDATED}),
    "sanitize_records": with_views(f"""
        SELECT record_id, {_AGE_I} AS age,
               {_enum_clean('gender', VALID_GENDERS)} AS gender,
               {_enum_clean('ethnicity', VALID_ETHNICITIES)} AS ethnicity,
               {_enum_clean('race', VALID_RACES)} AS race,
               CASE WHEN {_t('$.symptoms')} IS NULL THEN NULL
                    ELSE array_to_string({_SYM_CLEAN}, '|') END AS symptoms,
               CASE WHEN {_t('$.icd10')} IS NULL THEN NULL
                    ELSE array_to_string({_ICD_CLEAN}, ',') END AS icd10,
               CASE WHEN {_t('$.medications')} IS NULL THEN NULL
                    ELSE CAST(len({_MED_CLEAN}) AS BIGINT) END AS n_medications,
               CASE WHEN {_t('$.medications')} IS NULL THEN NULL
                    ELSE array_to_string(list_transform({_MED_CLEAN},
                           lambda x: CASE json_type(x, '$.name') WHEN 'VARCHAR'
                                     THEN json_extract_string(x, '$.name')
                                     ELSE CAST(json_extract(x, '$.name') AS VARCHAR) END), ',')
               END AS medication_names,
               CASE WHEN {_t('$.dob')} = 'VARCHAR' AND coalesce({_dob_valid('s_dob')}, false)
                    THEN s_dob END AS dob
        FROM (SELECT record_id, record AS j, json_extract_string(record, '$.dob') AS s_dob
              FROM recs) r""", "patients", extra=_REC),
    "emergency_flags": with_views(f"""
        SELECT record_id, hit IS NOT NULL AS is_emergency,
               CASE WHEN hit IS NOT NULL THEN 'Emergency symptom detected: ' || hit END
                   AS emergency_reason
        FROM (SELECT record_id,
                     list_filter({_PHRASES}, lambda p: coalesce(list_contains(lowered, p), false))[1]
                         AS hit
              FROM (SELECT record_id, {_LOWERED} AS lowered
                    FROM (SELECT record_id, record AS j FROM recs) r) a) b""",
        "patients", extra=_REC),
}


# ---------------------------------------------------------------- ingest round trips

INGEST = {
    # archive A: even ids (Id,user_id,event_type,value); every 50th id has an extra field
    # (dropped).  archive B: odd ids and ids divisible by 6 (Id,event_type,user_id); ids with
    # id % 9 = 1 miss user_id (null-filled).  Keep-first dedup on Id, archive A first.
    "merge_tables": """
        WITH a AS (SELECT event_id AS Id, user_id,
                          CASE WHEN event_id % 4 = 0 THEN event_type || ', "q"' ELSE event_type END
                              AS event_type, value, 0 AS src FROM events
                   WHERE event_id % 2 = 0 AND event_id % 50 <> 0),
             b AS (SELECT event_id AS Id, CASE WHEN event_id % 9 = 1 THEN NULL ELSE user_id END
                          AS user_id, event_type, CAST(NULL AS DOUBLE) AS value, 1 AS src
                   FROM events WHERE event_id % 2 = 1 OR event_id % 6 = 0),
             u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
        SELECT Id, user_id, event_type, value FROM (
          SELECT *, row_number() OVER (PARTITION BY Id ORDER BY src) AS rn FROM u) t
        WHERE rn = 1""",
    "csv_parquet_roundtrip": with_views("""
        SELECT CAST(START AS DATE) AS START, CAST(STOP AS DATE) AS STOP,
               PATIENT, CAST(CODE AS BIGINT) AS CODE, DESCRIPTION FROM conditions""",
        "conditions"),
    "typed_ingest": """
        SELECT event_id AS Id, CASE WHEN event_id % 5 <> 0 THEN user_id END AS USER_ID,
               CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 100 AS DOUBLE) ELSE value END AS VALUE,
               event_id % 2 = 0 AS FLAG,
               CASE WHEN event_id % 2 = 0 THEN 'True' ELSE CAST(event_id AS VARCHAR) END AS MIXED,
               CASE WHEN event_id % 7 = 0 THEN '1' || lpad(CAST(event_id AS VARCHAR), 20, '0')
                    ELSE CAST(event_id AS VARCHAR) END AS BIG,
               CASE WHEN event_id % 4 <> 0 THEN event_type || chr(10) || '"x", y' END AS TYPE,
               CAST(ts AS DATE) AS DATE, CAST(NULL AS VARCHAR) AS NOTHING
        FROM events""",
    "jsonl_roundtrip": with_views("SELECT text, label FROM samples", "conditions", "patients",
                                  extra=_corpus_sql(True)),
    "dedup_latest": """
        SELECT o_custkey AS Id, o_orderkey, o_orderdate, o_orderpriority FROM (
          SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
          FROM orders) t WHERE rn = 1""",
}


# ---------------------------------------------------------------- TF-IDF (M1)

from casebook.operators.tfidf import MAX_FEATURES, english_stop_words  # noqa: E402

_STOP = ", ".join(_q(w) for w in english_stop_words())

TFIDF = {
    "tfidf_top_terms": f"""
        WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'))
                            AS term FROM documents),
        tc AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term NOT IN ({_STOP})
               GROUP BY doc_id, term),
        nd AS (SELECT count(*) AS n FROM documents),
        terms AS (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM tc GROUP BY term),
        vocab AS (SELECT term, df, ln((CAST(1 AS DOUBLE) + nd.n) / (CAST(1 AS DOUBLE) + df)) + 1
                         AS idf
                  FROM terms, nd ORDER BY total_tf DESC, term ASC LIMIT {MAX_FEATURES}),
        w AS (SELECT tc.doc_id, tc.term, tc.tf * v.idf AS raw FROM tc JOIN vocab v ON tc.term = v.term),
        nw AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight
               FROM w)
        SELECT doc_id, rank, term, round(weight, 6) AS weight FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC,
                                                                  term ASC) AS BIGINT) AS rank
          FROM nw) t
        WHERE rank <= 5""",
}


# ---------------------------------------------------------------- coverage additions

FIRST_N = 500
REFINED_SEQ = 1 << 62   # the refined answer is seen after every specialist answer

MORE = {
    "distinct_counts": with_views("""
        SELECT 'codes' AS metric, CAST(count(DISTINCT CODE) AS BIGINT) AS n FROM conditions
        UNION ALL SELECT 'label_classes', CAST(count(DISTINCT label) AS BIGINT) FROM labelled_docs
        UNION ALL SELECT 'operations', CAST(count(DISTINCT operation) AS BIGINT) FROM latencies
        UNION ALL SELECT 'domains', CAST(count(DISTINCT domain) AS BIGINT)
                  FROM (SELECT domain FROM domain_map UNION ALL SELECT 'general') d""",
        "conditions", "labelled_docs", "latencies", "domain_map"),
    "prediction_rows_first_n": _with_ok(f"""
        SELECT * FROM (
          SELECT CAST(row_number() OVER (ORDER BY sample_id) - 1 AS BIGINT) AS sample_index,
                 sample_id, true_diagnosis, predicted_diagnosis, round(confidence, 6) AS confidence,
                 agent_used, correct
          FROM ok) t
        WHERE sample_index < {FIRST_N}"""),
}


REFINED_REASON = """CASE
    WHEN NOT coalesce(json_valid(raw), false) THEN 'not_a_json_object'
    WHEN json_type(raw) <> 'OBJECT' THEN 'not_a_json_object'
    WHEN list_sort(json_keys(raw)) <> ['confidence', 'diagnosis', 'reasoning'] THEN 'wrong_keys'
    WHEN TRY_CAST(json_extract_string(raw, '$.confidence') AS DOUBLE) IS NULL THEN 'bad_confidence'
  END"""

MORE["case_pipeline_refined"] = with_views("""
    SELECT s.case_id, s.diagnosis AS softmax_diagnosis, round(s.score, 6) AS softmax_score,
           m.diagnosis AS majority_diagnosis, round(m.score, 6) AS majority_score
    FROM ws s JOIN wm m ON s.case_id = m.case_id""",
    "notes", "agent_answers", "refined_outputs",
    extra={**_RF,
           "refined_ok": f"""
               SELECT case_id, line, json_extract_string(raw, '$.diagnosis') AS diagnosis,
                      TRY_CAST(json_extract_string(raw, '$.confidence') AS DOUBLE) AS confidence
               FROM (SELECT *, {REFINED_REASON} AS reject_reason FROM refined_outputs) r
               WHERE reject_reason IS NULL""",
           "refined_one": f"""
               SELECT case_id, 'refine' AS agent_id, diagnosis, confidence,
                      {REFINED_SEQ} AS seq1, 0 AS seq2, 0 AS seq3
               FROM (SELECT *, row_number() OVER (PARTITION BY case_id
                                                  ORDER BY line, diagnosis, confidence) AS rn
                     FROM refined_ok WHERE case_id IN (SELECT note_id FROM notes)) t
               WHERE rn = 1""",
           "cand_all": """
               SELECT case_id, agent_id, diagnosis, confidence, seq1, seq2, seq3 FROM fanout
               UNION ALL SELECT * FROM refined_one""",
           **_vote_ctes("cand_all"), "ws": _winner("vs"), "wm": _winner("vm")})

def _fallback_read(requested: str, domain: str, split: str) -> str:
    own = f"domain = '{domain}' AND split = '{split}'"
    gen = f"domain = 'general' AND split = '{split}'"
    return f"""
    SELECT '{requested}' AS requested, patient_id, label, domain, split FROM cs
    WHERE ({own})
       OR (NOT EXISTS (SELECT 1 FROM cs WHERE {own}) AND {gen})
       OR (NOT EXISTS (SELECT 1 FROM cs WHERE {own}) AND NOT EXISTS (SELECT 1 FROM cs WHERE {gen}))"""


MORE["domain_split_roundtrip"] = _corpus_with(
    _fallback_read("small/train", "small", "train") + "\n    UNION ALL"
    + _fallback_read("cardio/test", "cardio", "test"), "domain_map", ds=DOMAIN_SAMPLES,
    cs=f"""
        SELECT h.patient_id, h.label, h.domain,
               CASE WHEN row_number() OVER (PARTITION BY h.domain ORDER BY h.h, h.patient_id) - 1
                         < floor(nn.n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
        FROM (SELECT *, {_hash('patient_id')} AS h FROM ds) h
        JOIN (SELECT domain, count(*) AS n FROM ds GROUP BY domain
              HAVING count(*) > 10 OR domain = 'general') nn
          ON h.domain = nn.domain""")

MORE["eval_slice_roundtrip"] = SPLITS["eval_slice_last_condition"]

MORE["label_encoding"] = with_views("""
    SELECT d.doc_id, d.label, CAST(c.label_index AS INTEGER) AS label_index
    FROM labelled_docs d
    LEFT JOIN (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS label_index
               FROM (SELECT DISTINCT label FROM labelled_docs WHERE label IS NOT NULL) x) c
      ON d.label = c.label""", "labelled_docs")


# ---------------------------------------------------------------- operators with small results of their own

FIRST_SAMPLES = 25
DOMAIN_CONFIG = '{"first": {"codes": [1, 2, 3]}, "second": {"codes": ["3", "4"]}, "broken": {"x": 1}}'
# fixed values of the adapter: keywords that occur in the notes
ROUTER_CONFIG = ('{"prose": {"keywords": ["the", "and"], "agent_id": "en_agent"}, '
                 '"licensed": {"keywords": ["License"], "agent_id": "legal_agent"}}')


def _has_word(word: str) -> str:
    edge = "[^\\p{L}\\p{N}_]"
    return f"regexp_matches(lower(text), '(^|{edge}){word.lower()}($|{edge})')"


def _text_keyed(body: str, **extra) -> str:
    """The adapter's conditions and patients with text ids and, in places, no readable date."""
    bad = f"{_hash("concat_ws('|', PATIENT, CODE)")} % 50 = 0"
    ctes = {
        "raw_conditions": VIEW_SQL["conditions"], "raw_patients": VIEW_SQL["patients"],
        "conditions": f"""
            SELECT CASE WHEN {bad} THEN NULL ELSE START END AS START, {bad} AS is_bad,
                   'id-' || PATIENT AS PATIENT, CODE, DESCRIPTION FROM raw_conditions""",
        "patients": """
            SELECT 'id-' || ID AS ID, BIRTHDATE, GENDER, RACE, ETHNICITY FROM raw_patients""", **extra}
    return "WITH " + ",\n".join(f"{k} AS ({v}\n)" for k, v in ctes.items()) + "\n" + body


EXTRA = {
    "empty_exports": with_views("""
        SELECT DESCRIPTION, CAST(count(*) AS BIGINT) AS n FROM encounters GROUP BY DESCRIPTION""", "encounters"),
    "load_counts": with_views("""
        SELECT 'conditions' AS "table", 'ok' AS status, n AS rows, n AS merged_rows,
               CAST(0 AS BIGINT) AS duplicates_removed, CAST(0 AS BIGINT) AS rejected_dates
        FROM (SELECT count(*) AS n FROM conditions) c
        UNION ALL SELECT 'payers', 'skipped', 0, 0, 0, 0
        UNION ALL SELECT 'TOTAL', 'success', n, n, 0, 0 FROM (SELECT count(*) AS n FROM conditions) c""",
        "conditions"),
    "registered_views": """
        SELECT n_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "required_rows": with_views("""
        SELECT sample_id, true_diagnosis, predicted_diagnosis FROM predictions
        WHERE true_diagnosis IS NOT NULL AND predicted_diagnosis IS NOT NULL AND patient IS NOT NULL""",
        "predictions"),
    "result_documents": _with_ok("SELECT sample_id, true_diagnosis, correct FROM ok"),
    "domain_config": with_views("""
        SELECT CASE WHEN CODE IN ('1', '2') THEN 'first' WHEN CODE IN ('3', '4') THEN 'second'
                    ELSE 'general' END AS domain, CAST(count(*) AS BIGINT) AS n
        FROM conditions GROUP BY 1""", "conditions"),
    "router_config": with_views(f"""
        SELECT note_id, array_to_string(list_filter([
                   CASE WHEN {_has_word('the')} OR {_has_word('and')} THEN 'en_agent' END,
                   CASE WHEN {_has_word('License')} THEN 'legal_agent' END], lambda x: x IS NOT NULL), ',')
               AS agents
        FROM notes""", "notes"),
    "summary_csv": f"""
        WITH s AS ({EXPLORE['value_summary']})
        SELECT unnest(['n', 'mean', 'std', 'min', 'q25', 'q50', 'q75', 'max']) AS stat,
               unnest([CAST(n AS DOUBLE), mean, std, min, q25, q50, q75, max]) AS value
        FROM s""",
    "csv_column_subset": with_views("SELECT CAST(PATIENT AS VARCHAR) AS PATIENT, CODE FROM conditions",
                                    "conditions"),
    "record_log": with_views("""
        SELECT operation, 'm_' || operation AS model, CAST(count(*) AS BIGINT) AS n,
               round(sum(duration_ms), 3) AS total_ms
        FROM latencies GROUP BY operation""", "latencies"),
    "limited_samples": _corpus_with(
        f"SELECT patient_id, label FROM samples ORDER BY patient_id LIMIT {FIRST_SAMPLES}"),
    "score_maps": with_views("""
        SELECT case_id, string_agg(diagnosis || '=' || CAST(CAST(round(score * 1000) AS BIGINT) AS VARCHAR), ','
                                   ORDER BY diagnosis) AS scores
        FROM vs GROUP BY case_id""", "agent_answers", extra=_vote_ctes("agent_answers")),
    "dedup_counts": """
        SELECT count(*) AS rows_before, count(DISTINCT o_custkey) AS rows_after,
               count(*) - count(DISTINCT o_custkey) AS removed,
               round((count(*) - count(DISTINCT o_custkey)) * 100.0 / count(*), 6) AS removed_pct
        FROM orders""",
    "corpus_prompts_text_keys": _text_keyed(f"""
        SELECT patient_id, text, label,
               CASE WHEN row_number() OVER (ORDER BY {_hash('patient_id')}, patient_id) - 1
                         < floor((SELECT count(*) FROM samples) * CAST(0.8 AS DOUBLE))
                    THEN 'train' ELSE 'test' END AS split
        FROM samples""", **_corpus_sql(True)),
    "rejected_dates": _text_keyed("""
        SELECT 'START' AS "column", count(*) AS n_rows,
               count(*) FILTER (WHERE NOT is_bad AND START IS NULL) AS n_missing,
               count(*) FILTER (WHERE is_bad) AS n_rejected
        FROM conditions
        UNION ALL SELECT 'BIRTHDATE', count(*), count(*) FILTER (WHERE BIRTHDATE IS NULL), 0 FROM patients"""),
}


# ---------------------------------------------------------------- logistic-regression baseline (M2, M3)

def baseline_sql(body: str, docs: str, max_features: int, *views: str) -> str:
    """The baseline by another road than Spark's: features from plain windows, every model by
    accelerated gradient descent with a fixed step (20 sqrt(condition number) rounds), then
    the test rows' greatest margins as ``ok`` (true_diagnosis, predicted_diagnosis)."""
    steps = {
        "d": docs,
        "s": f"""SELECT doc_id, label, text, {_hash('doc_id')} AS h,
                        CASE WHEN (SELECT min(c) FROM (SELECT label, count(*) AS c FROM d GROUP BY label) x) >= 2
                             THEN label ELSE '*' END AS stratum
                 FROM d WHERE label IS NOT NULL""",
        "sp": """SELECT s.doc_id, s.label, s.text,
                        row_number() OVER (PARTITION BY s.stratum ORDER BY s.h, s.doc_id) - 1
                            < floor(nn.n * CAST(0.75 AS DOUBLE)) AS fitted
                 FROM s JOIN (SELECT stratum, count(*) AS n FROM s GROUP BY stratum) nn ON s.stratum = nn.stratum""",
        "tc": f"""SELECT doc_id, fitted, term, count(*) AS tf
                  FROM (SELECT doc_id, fitted, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'))
                               AS term FROM sp) t
                  WHERE term NOT IN ({_STOP}) GROUP BY doc_id, fitted, term""",
        "nd": "SELECT count(*) AS n, 1 + count(*) / 2 AS lip, sqrt(1 + count(*) / 2) AS root FROM sp WHERE fitted",
        "vocab": f"""SELECT term, ln((CAST(1 AS DOUBLE) + nd.n) / (CAST(1 AS DOUBLE) + df)) + 1 AS idf
                     FROM (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM tc WHERE fitted GROUP BY term) t,
                          nd
                     ORDER BY total_tf DESC, term LIMIT {max_features}""",
        "raw": "SELECT doc_id, fitted, tc.term, tf * idf AS raw FROM tc JOIN vocab ON tc.term = vocab.term",
        "x": """SELECT doc_id, fitted, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS val FROM raw
                UNION ALL SELECT doc_id, fitted, '', 1.0 FROM sp""",
        "names": "SELECT DISTINCT label FROM sp",
        "model": """SELECT label FROM names WHERE (SELECT count(*) FROM names) > 2
                                               OR label = (SELECT max(label) FROM names)""",
        "y": """SELECT sp.doc_id, model.label, CASE WHEN sp.label = model.label THEN 1.0 ELSE -1.0 END AS side
                FROM sp, model WHERE fitted""",
        "fx": "SELECT doc_id, term, val FROM x WHERE fitted",
        "descent(t, label, term, w, w0)": """
            SELECT 0, label, term, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
            FROM model, (SELECT DISTINCT term FROM fx) f
            UNION ALL
            SELECT a.t + 1, a.label, a.term,
                   (a.w + (nd.root - 1) / (nd.root + 1) * (a.w - a.w0)) * (1 - 1 / nd.lip) - g.slope / nd.lip, a.w
            FROM descent a
            JOIN (SELECT m.label, fx.term, sum(m.pull * fx.val) AS slope
                  FROM fx JOIN (
                      SELECT y.doc_id, y.label, -y.side / (1 + exp(y.side * z.z)) AS pull
                      FROM y JOIN (SELECT fx.doc_id, b.label,
                                          sum(fx.val * (b.w + (nd.root - 1) / (nd.root + 1) * (b.w - b.w0))) AS z
                                   FROM fx JOIN descent b ON b.term = fx.term, nd
                                   GROUP BY fx.doc_id, b.label) z
                        ON z.doc_id = y.doc_id AND z.label = y.label) m ON m.doc_id = fx.doc_id
                  GROUP BY m.label, fx.term) g ON g.label = a.label AND g.term = a.term, nd
            WHERE a.t < 20 * nd.root""",
        "w": "SELECT label, term, w FROM descent WHERE t = (SELECT max(t) FROM descent)",
        "z": """SELECT x.doc_id, w.label, sum(x.val * w.w) AS z FROM x JOIN w ON x.term = w.term
                WHERE NOT x.fitted GROUP BY x.doc_id, w.label""",
        "told": """SELECT doc_id, CASE WHEN (SELECT count(*) FROM names) > 2 THEN arg_max(label, z)
                                       WHEN max(z) > 0 THEN max(label)
                                       ELSE (SELECT min(label) FROM names) END AS label
                   FROM z GROUP BY doc_id""",
        "ok": """SELECT sp.label AS true_diagnosis, told.label AS predicted_diagnosis
                 FROM sp JOIN told ON told.doc_id = sp.doc_id""",
        "pc": PER_CLASS, "cls": CLS,
    }
    return with_views(body, *views, extra=steps).replace("WITH ", "WITH RECURSIVE ", 1)


BASELINE_REPORT = f"""
    SELECT 'accuracy' AS metric, round(avg(CASE WHEN true_diagnosis = predicted_diagnosis THEN 1.0 ELSE 0.0 END), 6)
           AS value FROM ok
    UNION ALL SELECT 'f1_macro', f1 FROM ({CLASS_REPORT}) r WHERE label = 'macro avg'
    UNION ALL SELECT 'f1_weighted', f1 FROM ({CLASS_REPORT}) r WHERE label = 'weighted avg'
    UNION ALL SELECT 'n_test', CAST(count(*) AS DOUBLE) FROM ok
    UNION ALL SELECT 'n_train', CAST(n AS DOUBLE) FROM nd
    UNION ALL SELECT 'n_features', CAST(count(*) AS DOUBLE) FROM vocab
    UNION ALL SELECT 'n_classes', CAST(count(DISTINCT true_diagnosis) AS DOUBLE) FROM ok
    UNION ALL SELECT m.name || '[' || label || ']',
                     CASE m.name WHEN 'precision' THEN precision WHEN 'recall' THEN recall
                                 WHEN 'f1' THEN f1 ELSE CAST(support AS DOUBLE) END
              FROM ({CLASS_REPORT}) r, (SELECT unnest(['precision', 'recall', 'f1', 'support']) AS name) m"""

LANGUAGE_FEATURES = 400

BASELINE = {
    "logit_baseline_report": baseline_sql(BASELINE_REPORT, "SELECT doc_id, text, label FROM labelled_docs",
                                          MAX_FEATURES, "labelled_docs"),
    "logit_models": baseline_sql("""
        SELECT w.label, (SELECT count(*) FROM vocab) AS n_features, round(sqrt(sum(w * w)), 4) AS weight_norm,
               round(sum(w) FILTER (WHERE term = ''), 4) AS intercept, true AS at_optimum
        FROM w GROUP BY w.label""", "SELECT doc_id, text, lang AS label FROM documents", LANGUAGE_FEATURES),
    "logit_languages": baseline_sql("""
        SELECT true_diagnosis, predicted_diagnosis, count(*) AS n FROM ok GROUP BY ALL""",
        "SELECT doc_id, text, lang AS label FROM documents", LANGUAGE_FEATURES),
}


# ---------------------------------------------------------------- loads one after the other

_EVENT_LOADS = """
    WITH e AS (SELECT i, CASE WHEN event_id % 101 > 0 THEN event_id END AS Id, user_id,
                      event_type || '/' || i AS event_type, CASE WHEN i > 0 THEN value END AS value, event_id
               FROM events, range(0, 3) t(i)
               WHERE event_id % 3 = i OR event_id % 7 = i OR event_id % 11 = 0),
    kept AS (SELECT *, row_number() OVER (PARTITION BY Id ORDER BY i, event_id) AS rn FROM e)"""

LOADS = {
    "incremental_merge": f"{_EVENT_LOADS} SELECT Id, user_id, event_type, value FROM kept WHERE rn = 1",
    "incremental_report": f"""{_EVENT_LOADS}
        SELECT 'part' || i AS load, CAST(count(*) AS BIGINT) AS rows_in,
               CAST(count(*) FILTER (WHERE rn = 1) AS BIGINT) AS rows_new FROM kept GROUP BY i""",
    "cutoff_from_states": with_views("SELECT quantile_disc(START, 0.8) AS cutoff FROM conditions", "conditions"),
    "key_counts_from_states": with_views("""
        SELECT count(*) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std,
               CAST(min(n) AS DOUBLE) AS min, round(quantile_cont(n, 0.25), 6) AS q25,
               round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.75), 6) AS q75,
               CAST(max(n) AS DOUBLE) AS max
        FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM conditions GROUP BY PATIENT) c""", "conditions"),
    "distinct_from_states": with_views("""
        SELECT 'CODE' AS "column", CAST(count(DISTINCT CODE) AS BIGINT) AS n FROM conditions
        UNION ALL SELECT 'PATIENT', CAST(count(DISTINCT PATIENT) AS BIGINT) FROM conditions""", "conditions"),
    "corpus_prompts_laid_out": corpus_prompts_sql(False),
}
