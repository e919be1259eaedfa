"""One query for each operator of this subpackage, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import chat as _chat
from plumbline.llm import fingerprints as _fingerprints
from plumbline.llm import html_wrappers as _html_wrappers
from plumbline.llm import lang_id as _lang_id
from plumbline.llm import mixing as _mixing
from plumbline.llm import ngram_join as _ngram_join
from plumbline.llm import packing as _packing
from plumbline.llm import quality as _quality
from plumbline.llm import secret_scan as _secrets
from plumbline.llm import token_files as _token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _quality.quality(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprints.fingerprint(_table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.scan(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html_wrappers.extract(_table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return _token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat.rotate(_table(spark, sf_dir, "conversations"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lang_id.language_id(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram_join.similar_groups(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return _packing.pack(_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mixture(_table(spark, sf_dir, "documents"), max_repeats=2.0)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_secret_scans": op3_secret_scans,
    "op4_html_extraction": op4_html_extraction,
    "op5_token_files": op5_token_files,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_language_id": op7_language_id,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
}

_STOP = ", ".join(f"'{w}'" for w in _quality.STOP_WORDS)

_OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c >= 2),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
         len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1)) AS n_upper_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•‣–]\s'))) AS n_bullet_lines
  FROM d LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 16
       AND n_symbols / greatest(word_chars, 1) <= 0.05::DOUBLE
       AND n_stop_words / greatest(n_words, 1) >= 0.02::DOUBLE
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5::DOUBLE
       AND n_ellipsis_lines / greatest(n_lines, 1) <= 0.3::DOUBLE
       AND n_bullet_lines / greatest(n_lines, 1) <= 0.9::DOUBLE
       AND n_upper_words / greatest(n_words, 1) <= 0.6::DOUBLE AS kept
FROM b
"""

_OP6 = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, regexp_replace(replace(coalesce(role, 'unknown'), '<|im_', '< |im_'), '[ \t\n\v\f\r]+', ' ', 'g') AS role,
         replace(coalesce(text, ''), '<|im_', '< |im_') AS text
  FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role <> 'system'),
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1) AS i FROM t),
b AS (
  SELECT conv_id, perspective, i // 512 AS part, i, role, text, role = perspective AS own,
         CASE WHEN role = perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || role || chr(10) END AS head
  FROM n JOIN p ON conv_id IS NOT DISTINCT FROM c),
s AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 11) OVER (
           PARTITION BY conv_id, perspective, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM b)
SELECT conv_id, perspective, part::BIGINT AS part, count(*) AS n_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY i) AS text,
       coalesce(string_agg((begins + length(head))::BIGINT || ':' || (begins + length(head) + length(text) + 10)::BIGINT, ',' ORDER BY i) FILTER (WHERE own), '') AS spans
FROM s GROUP BY ALL
"""

_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS t, sum(sum(n_tokens)) OVER ()::DOUBLE AS a FROM d GROUP BY source),
search AS (
  SELECT 0 AS i, 0::DOUBLE AS low, 1::DOUBLE AS step
  UNION ALL
  SELECT i + 1, CASE WHEN (SELECT max(pow(t, low + step / 2 - 1)) / min(pow(t, low + step / 2 - 1)) FROM s WHERE t > 0) > 2 THEN low + step / 2 ELSE low END, step / 2
  FROM search WHERE i < 30),
e AS (SELECT CASE WHEN (SELECT max(1 / t::DOUBLE) / min(1 / t::DOUBLE) FROM s WHERE t > 0) <= 2 THEN 0 ELSE round(low + step, 6) END AS x FROM search WHERE i = 30),
r AS (
  SELECT source, t, greatest(1, ceil(t / 100000))::BIGINT AS blocks,
         CASE WHEN t > 0 THEN round((SELECT max(t / pow(t / a, x)) FROM s, e WHERE t > 0) * pow(t / a, x) / t, 9) ELSE 1 END AS repeats
  FROM s, e),
q AS (SELECT *, floor(repeats)::BIGINT AS passes, floor((repeats - floor(repeats)) * t)::BIGINT AS rest FROM r),
u AS (
  SELECT doc_id, d.source, n_tokens, repeats, passes, rest, blocks, copy,
         ('0x' || substr(md5('0|' || copy || '|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS place
  FROM (SELECT d.*, q.* EXCLUDE (source, t), unnest(range(0, passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS copy
        FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source) d),
c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, copy ORDER BY place >> 24) AS cum FROM u),
f AS (
  SELECT *, min(CASE WHEN cum > rest THEN place >> 24 END) OVER (PARTITION BY source, copy) AS cut FROM c)
SELECT doc_id, source, n_tokens, copy, copy * blocks + floor(place / 281474976710656.0::DOUBLE * blocks)::BIGINT AS block,
       round((copy * blocks + floor(place / 281474976710656.0::DOUBLE * blocks) + 0.5::DOUBLE) / ceil(repeats * blocks), 9) AS position
FROM f WHERE copy < passes OR cut IS NULL OR place >> 24 < cut
"""

ORACLES = {
    "op6_chat_formatting": _OP6,
    "op10_mixing": _OP10,
    "op1_quality_rules": _OP1,
}
