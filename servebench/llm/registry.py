"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_classify, q_dedup, q_manifest, q_quality, q_tokens, q_urls

QueryFn = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, QueryFn]:
    return {f.__name__: f for f in (
        q_quality.op1_quality_rules, q_dedup.op2_vector_dedup, q_dedup.op3_suffix_dedup, q_urls.op4_url_filter,
        q_dedup.op5_jaccard_join, q_tokens.op6_packing, q_tokens.op7_bpe, q_classify.op8_lm_scoring,
        q_classify.op9_quality_classifier, q_classify.op10_toxicity, q_manifest.op11_merkle_manifest,
        q_manifest.op12_conversation_repair, q_manifest.op13_fingerprints)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": q_quality.sql(), "op2_vector_dedup": q_dedup.op2_sql(), "op3_suffix_dedup": q_dedup.op3_sql(),
            "op4_url_filter": q_urls.sql(), "op5_jaccard_join": q_dedup.op5_sql(),
            "op11_merkle_manifest": q_manifest.op11_sql(), "op12_conversation_repair": q_manifest.op12_sql()}
