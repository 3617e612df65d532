"""Deterministic ids and order keys.

``md5`` gives the same hex digest in Spark and in SQL engines, so sampled and
shuffled output is reproducible and checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col_

ID_HEX = 12


def entry_id(source: Column | str, origin_key: Column | str) -> Column:
    """First 12 hex digits of ``md5(source ':' key)``."""
    return F.substring(F.md5(F.concat_ws(":", col_(source), col_(origin_key).cast("string"))), 1, ID_HEX)


def order_key(id_col: Column | str, seed: int | str = 0) -> Column:
    """Sort key for deterministic random order: ``md5(id '#' seed)``."""
    return F.md5(F.concat(col_(id_col).cast("string"), F.lit("#"), F.lit(str(seed))))


def unit_hash(text: Column) -> Column:
    """A value in [0, 1) from the first 15 hex digits of ``md5(text)``."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") / F.lit(float(16 ** 15))


def hash_int(text: Column) -> Column:
    """A non-negative BIGINT from the first 15 hex digits of ``md5(text)``."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
