"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame.

Each query is thin: it reads its table, calls one operator with production parameters and
derives the result's digest columns.  ``ORACLE`` holds DuckDB SQL where SQL can express the
operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import (ann_mih, byte_bpe, filter_audit, hmm, langid_kn, merkle_jump, minhash_oph,
                          packing, quality_pu, simhash_gray, substring_dedup, token_counts, topk_taat)
from casebook.llm.common import fold, read, stage

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), WORD_BPE, limit=2048)


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"),
                               fold("doc_id", 4) == 2)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_kn.identify(read(spark, sf_dir, "documents"), fold("doc_id", 5) == 0)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_mih.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_gray.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, limit=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(read(spark, sf_dir, "documents"), WORD_BPE, capacity=4096, end_id=1)
    items = stage(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(items, capacity=4096)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_taat.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle_jump.manifest(read(spark, sf_dir, "documents"), tampered,
                                 {"n_chars": F.try_add(F.col("n_chars"), F.lit(1))})
    return found.select("doc_id", "leaf", "subroot", "root",
                        merkle_jump.siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_oph.near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_hmm": op2_hmm,
    "op3_quality_pu": op3_quality_pu,
    "op4_langid": op4_langid,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_nearest": op6_nearest,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_topk": op10_topk,
    "op11_merkle": op11_merkle,
    "op12_minhash": op12_minhash,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE = {
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
                   FROM documents),
        win AS (SELECT doc_id, i, array_to_string(words[i:i + 34], ' ') AS w
                FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d
                      WHERE len(words) >= 35) x),
        twice AS (SELECT w FROM win GROUP BY w HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS p
                 FROM (SELECT doc_id, i FROM win SEMI JOIN twice USING (w)) h, range(0, 35) t(j)),
        word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS k
                 FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words,
               CAST(len(d.words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept.k, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_topk": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id,
                          [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0
                     AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id,
                     CAST(list_sum([q.w[i] * v.w[i] FOR i IN range(1, len(v.w) + 1)]) AS BIGINT)
                         AS score
              FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.w) = len(v.w)
              WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
          FROM s) t
        WHERE rank <= 20""",
    "op11_merkle": """
        WITH RECURSIVE d AS (SELECT *, CASE WHEN n_chars IS NULL THEN '-' ELSE
                   strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS own_n,
                 CASE WHEN n_chars IS NULL THEN '-' ELSE
                   strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) END AS other_n,
                 CASE WHEN doc_id IS NULL THEN '-' ELSE
                   strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
                 || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
                 || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
                 CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail
              FROM documents),
        leaf AS (SELECT doc_id, lang, leaf, bad, CAST(row_number() OVER (PARTITION BY lang
                        ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS pos
                 FROM (SELECT doc_id, lang, sha256(head || own_n || tail) AS leaf,
                              sha256(head || other_n || tail) AS bad FROM d) t),
        tree(lang, level, pos, h) AS (
            SELECT lang, 0, pos, leaf FROM leaf
            UNION ALL
            SELECT lang, level + 1, pos // 2, string_agg_hash FROM (
                SELECT lang, level, pos // 2 * 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS string_agg_hash
                FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM tree) t WHERE n > 1
                GROUP BY lang, level, pos // 2 * 2) u),
        height AS (SELECT lang, max(level) AS top FROM tree GROUP BY lang),
        sub AS (SELECT t.lang, t.h, CAST(row_number() OVER (ORDER BY t.lang NULLS FIRST) - 1 AS BIGINT) AS pos
                FROM tree t JOIN height g ON t.lang IS NOT DISTINCT FROM g.lang AND t.level = g.top),
        upper(level, pos, h) AS (
            SELECT 0, pos, h FROM sub
            UNION ALL
            SELECT level + 1, pos // 2, next_hash FROM (
                SELECT level, pos // 2 * 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS next_hash
                FROM (SELECT *, count(*) OVER () AS n FROM upper) t WHERE n > 1
                GROUP BY level, pos // 2 * 2) u),
        root AS (SELECT h FROM upper ORDER BY level DESC LIMIT 1),
        step AS (
            SELECT l.lang, l.pos, g.level, tree_s.h AS sibling, tree_s.pos % 2 = 0 AS on_left
            FROM leaf l JOIN height g0 ON l.lang IS NOT DISTINCT FROM g0.lang
            JOIN (SELECT DISTINCT lang, level FROM tree) g
              ON g.lang IS NOT DISTINCT FROM l.lang AND g.level < g0.top
            LEFT JOIN tree tree_s ON tree_s.lang IS NOT DISTINCT FROM l.lang AND tree_s.level = g.level
                 AND tree_s.pos = xor(l.pos >> g.level, 1)
            UNION ALL
            SELECT l.lang, l.pos, g0.top + v.level, u.h, u.pos % 2 = 0
            FROM leaf l JOIN height g0 ON l.lang IS NOT DISTINCT FROM g0.lang
            JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang
            JOIN (SELECT DISTINCT level FROM upper) v ON v.level < (SELECT max(level) FROM upper)
            LEFT JOIN upper u ON u.level = v.level AND u.pos = xor(sub.pos >> v.level, 1)),
        proof AS (SELECT lang, pos, list(struct_pack(s := sibling, l := on_left) ORDER BY level) AS way,
                         coalesce(string_agg(sibling, '' ORDER BY level), '') AS siblings
                  FROM step GROUP BY lang, pos),
        fold(lang, pos, i, h) AS (
            SELECT lang, pos, 0, CASE WHEN crc32_hit THEN bad ELSE leaf END
            FROM (SELECT *, doc_id IS NOT NULL AND xor(list_reduce(
                      list_prepend(4294967295, [CAST(ascii(c) AS BIGINT)
                                                FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
                      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 7 = 0 AS crc32_hit
                  FROM leaf) t
            UNION ALL
            SELECT f.lang, f.pos, i + 1, sha256(CASE WHEN way[i + 1].s IS NULL THEN f.h
                WHEN way[i + 1].l THEN way[i + 1].s || f.h ELSE f.h || way[i + 1].s END)
            FROM fold f JOIN proof p ON p.pos = f.pos AND p.lang IS NOT DISTINCT FROM f.lang
            WHERE i < len(way)),
        folded AS (SELECT lang, pos, arg_max(h, i) AS h FROM fold GROUP BY lang, pos)
        SELECT leaf.doc_id, leaf.leaf, sub.h AS subroot, root.h AS root,
               sha256(coalesce(proof.siblings, '')) AS proof_sha256, folded.h AS folded_root,
               folded.h = root.h AS verified
        FROM leaf JOIN sub ON sub.lang IS NOT DISTINCT FROM leaf.lang
        JOIN folded ON folded.pos = leaf.pos AND folded.lang IS NOT DISTINCT FROM leaf.lang
        LEFT JOIN proof ON proof.pos = leaf.pos AND proof.lang IS NOT DISTINCT FROM leaf.lang, root""",
    "op12_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
               FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
                     ELSE [w[i:i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
                 FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                 WHERE 100 * k >= 85 * (x.n + y.n - k)),
        way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents
                             UNION SELECT reach.doc_id, way.b FROM reach JOIN way ON way.a = reach.r),
        least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.component_id,
               w.doc_id = least.component_id AS kept
        FROM w LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)""",
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        mark AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic
                 FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text)
                        THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed
              FROM t LEFT JOIN mark USING (doc_id)),
        sets AS (SELECT part, failed, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic
                 FROM f GROUP BY part, failed),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
              FROM l a, l b, l c, l d, l e
              WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        z AS (SELECT sets.*, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter,
                     contains(failed, filter_order[step]) AS fails,
                     len(list_filter(string_split(filter_order[1:step - 1], ''),
                                     lambda y: y <> '' AND contains(failed, y))) > 0 AS gone
              FROM sets, o, range(1, 6) r(step)),
        c AS (SELECT part, filter_order, step, letter,
                     CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
                     CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
                     CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant,
                     CAST(coalesce(sum(n) FILTER (failed = letter), 0) AS BIGINT) AS unique_fails,
                     CAST(coalesce(sum(n_good) FILTER (NOT gone AND fails), 0) AS BIGINT) AS good_lost,
                     CAST(coalesce(sum(n_toxic) FILTER (NOT gone AND fails), 0) AS BIGINT) AS toxic_lost
              FROM z GROUP BY part, filter_order, step, letter)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM c""",
}
