"""Queries of operators 8 (LM scoring), 9 (quality classifier) and 10 (toxicity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance as I
from . import ppm
from . import toxicity as T
from .tables import crc_mod, table


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = T.learn(docs, table(spark, sf_dir, "labels"))
    return T.score(docs, grammar).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))
