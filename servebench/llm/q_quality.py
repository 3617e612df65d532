"""Query and SQL of operator 1 (quality rules)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality_rules as QR
from .tables import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QR.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def sql(docs: str = "documents") -> str:
    """DuckDB SQL for the rows of ``op1_quality_rules`` over ``docs`` (unique doc_id)."""
    bits = " + ".join(f"CASE WHEN {r.failed} THEN {1 << r.bit} ELSE 0 END" for r in QR.RULES)
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {words} AS w FROM {docs}),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
hit AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM hit, range(3) AS r(k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
          FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines,
        CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
        CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
        CAST(length(regexp_replace(text, '[^!]', '', 'g')) AS BIGINT) AS n_marks
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({bits}) & {QR.BASE.mask} <> 0 AS base_failed,
       ({bits}) & {QR.BASE.mask | QR.STRICT.mask} = 0 AS kept,
       CAST({bits} AS BIGINT) AS failed
FROM m"""
