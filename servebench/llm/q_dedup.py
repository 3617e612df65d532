"""Queries of operators 2, 3 and 5 (near-dedup of vectors, suffixes, shingle sets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import jaccard, suffix, vectors
from .tables import table


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removals(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_sql() -> str:
    """DuckDB SQL for the rows of ``op2_vector_dedup`` (unique vec_id), brute force."""
    return """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, root) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(root, e.vec_id) AS component_id, coalesce(root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least ON least.node = e.vec_id"""


def op5_sql() -> str:
    """DuckDB SQL for the rows of ``op5_jaccard_join`` (unique doc_id)."""
    return r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
          JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach(node, root) AS (SELECT DISTINCT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.node = d.doc_id"""


def op3_sql() -> str:
    """DuckDB SQL for the rows of ``op3_suffix_dedup`` (unique doc_id, not NULL)."""
    return """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s
      FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d WHERE length(x) >= 100)),
hit AS (SELECT doc_id, i FROM w QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r
        FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS before FROM span),
cut AS (SELECT g.doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last,
               string_agg(substr(x, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS kept
        FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""
