"""The queries of the training-data operators and, where SQL can say the same, their SQL for DuckDB."""
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc, bpe, chat_format, decontaminate, language_id, near_dedup, pii, quality_knn, quality_rules, token_output
from .common import table

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"), percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.round_trip(table(spark, sf_dir, "pages"))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(table(spark, sf_dir, "documents"), WORD_MODEL, 2)


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.digest(chat_format.conversations(rows.unionByName(extra)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SPLIT = r"[\x20\x09-\x0D]+"

OP2_SQL = rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPLIT}'), lambda x: x <> '') AS words
  FROM documents
), win AS (
  SELECT rid, i, list_slice(words, i, i + 4) AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), dup AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM win
), cover AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY rid
), lines AS (
  SELECT rid, string_split(text, chr(10)) AS all_lines,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w
), m AS (
  SELECT doc_id, text, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(all_lines) AS n_lines,
         coalesce(cover.n, 0) AS n_repeat_words
  FROM w JOIN lines USING (rid) LEFT JOIN cover USING (rid)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words
            OR 2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > length(text)
            OR 2 * length(regexp_replace(text, '[^!]+', '', 'g')) > n_words
            OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)
            OR length(text) > 30 * n_words OR length(text) < 2 * n_words) AS kept
FROM m
"""

OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPLIT}'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE list_slice(words, i, i + 4) END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
FROM q
"""

OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), t AS (
  SELECT *, CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
            ELSE 1 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) END AS label,
         length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS shown,
         lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
         lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + label + 2 + shown + 8)::BIGINT AS formatted_chars,
       bool_and(prev || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant',
                'assistant>user', 'assistant>tool', 'tool>assistant')) AND bool_or(last AND role = 'assistant') AS valid
FROM t GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op4_setsketch_dedup": OP4_SQL, "op6_arc_to_warc": OP6_SQL, "op10_chat_format": OP10_SQL}
