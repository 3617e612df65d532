"""Ranks of 64-bit keys inside groups, from bitmaps instead of a sort.

Every group's keys become one sparse bitmap: only its non-empty 64-bit words are
rows.  A popcount directory above the words (blocks of 2^16 words, then regions
of 2^21 blocks, then the group) says how many rows lie before each word, so a
rank is directory + popcount of the lower bits of the word.  The bitmaps of all
tasks merge by bitwise OR.  No window holds more than 2^21 directory entries, however many
rows a group has; keys that occur more than once keep their surplus beside the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

_WORD, _BLOCK, _REGION = 6, 22, 43      # bits of a key below a word, a block, a region


def directory(keys: DataFrame, group: list[str], key: str) -> DataFrame:
    """The words of all groups: ``group``, word, bits, extra [(bit, surplus rows)], before."""
    per_key = keys.groupBy(*group, key).agg(F.count("*").alias("m"))
    words = (per_key.groupBy(*group, F.shiftright(key, _WORD).alias("word"))
             .agg(F.expr(f"bit_or(shiftleft(1L, cast(`{key}` & 63 AS int)))").alias("bits"), F.sum("m").alias("n"),
                  F.expr(f"collect_list(CASE WHEN m > 1 THEN named_struct('bit', cast(`{key}` & 63 AS int), 'more', m - 1) END)").alias("extra"))
             .withColumn("block", F.shiftright("word", _BLOCK - _WORD)))
    blocks = words.groupBy(*group, "block").agg(F.sum("n").alias("n")).withColumn("region", F.shiftright("block", _REGION - _BLOCK))
    regions = blocks.groupBy(*group, "region").agg(F.sum("n").alias("n"))
    regions = regions.select(*group, "region", _before([*group], "region").alias("r_before"))
    blocks = (blocks.select(*group, "region", "block", _before([*group, "region"], "block").alias("b_before"))
              .join(regions, [*group, "region"]).select(*group, "block", (F.col("b_before") + F.col("r_before")).alias("b_before")))
    return (words.select(*group, "block", "word", "bits", "extra", _before([*group, "block"], "word").alias("w_before"))
            .join(blocks, [*group, "block"]).select(*group, "word", "bits", "extra", (F.col("w_before") + F.col("b_before")).alias("before")))


def _before(group: list[str], order: str) -> Column:
    """Rows of the entries before this one (every entry has its count ``n``)."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0))


def ranked(rows: DataFrame, group: list[str], key: str, rank: str, repeated: str) -> DataFrame:
    """``rows`` with the number of rows of their group that have a smaller key, and
    whether another row of the group has the same key.  Keys and group columns are not NULL."""
    words = directory(rows, group, key)
    bit = f"cast(`{key}` & 63 AS int)"
    here = rows.withColumn("word", F.shiftright(key, _WORD)).join(words, [*group, "word"])
    return here.withColumns({
        rank: F.expr(f"before + bit_count(bits & ~shiftleft(-1L, {bit})) + "
                     f"aggregate(extra, 0L, (a, e) -> CASE WHEN e.bit < {bit} THEN a + e.more ELSE a END)"),
        repeated: F.expr(f"exists(extra, e -> e.bit = {bit})"),
    }).drop("word", "bits", "extra", "before")


def copies_numbered(rows: DataFrame, group: list[str], row: str, out: str) -> DataFrame:
    """Numbers the rows of a group 0, 1, ... in the order of ``row`` (a
    ``monotonically_increasing_id``): per input partition, then by the partitions' counts."""
    r = rows.withColumn("part", F.shiftright(row, 33))
    counts = r.groupBy(*group, "part").agg(F.count("*").alias("n"))
    first = counts.select(*group, "part", _before(group, "part").alias("first"))
    at = F.row_number().over(Window.partitionBy(*group, "part").orderBy(row)) - 1
    return r.withColumn("at_", at).join(first, [*group, "part"]).withColumn(out, F.col("first") + F.col("at_")).drop("part", "at_", "first")


def ordinals(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with its row number (from 0) in the given order: range-partitioned, numbered
    per partition, shifted by the partitions' counts.  The result is read from a cut."""
    s = (df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_", F.monotonically_increasing_id()))
    s = cut(s.withColumn("part_", F.shiftright("row_", 33)))
    counts = s.groupBy("part_").agg(F.count("*").alias("n"))          # a row per partition
    first = counts.select("part_", F.coalesce(F.sum("n").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_"))
    return s.join(first, "part_").withColumn(out, F.col("first_") + F.col("row_").bitwiseAND((1 << 33) - 1)).drop("part_", "row_", "first_")
