"""Query and SQL of operator 4 (URL filters)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import url_filter as U
from .tables import table


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.filter_urls(table(spark, sf_dir, "pages"))


def sql() -> str:
    """DuckDB SQL for the rows of ``op4_url_filter``."""
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in U.RULES)
    return rf"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r(rhost, rpath, rverdict) AS (VALUES {rules}),
best AS (SELECT page_id, host, path, rhost || rpath AS rule, rverdict
         FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
         QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, rhost || rpath) = 1)
SELECT q.page_id, q.host, q.path, best.rule, coalesce(best.rverdict, '{U.DEFAULT_VERDICT}') AS verdict
FROM q LEFT JOIN best USING (page_id)"""
