"""Queries of operators 6 (packing) and 7 (byte-level BPE)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, packing
from .tables import table

PACKING_FILE = "byte_bpe_50k.json"
BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def tokenizer(name: str) -> tuple[str, str]:
    """Path and pretoken pattern of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(packing.pieces(docs, *tokenizer(PACKING_FILE)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), *tokenizer(BPE_FILE))
