"""First-N selection and ranks per group without sorting a group in one task.

``first_n`` finds each group's N-th smallest key by counting key prefixes:
one map-side-combined count per prefix, a running sum over a group's
prefixes, then the same inside the one prefix in which the quota runs out.
What remains is a filter against one threshold per group.  ``ranked`` numbers
rows whose order key is a hash: the hash's leading digits part a group evenly, the
parts' counts give each part's first rank, and rows are numbered inside the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bits of a whole-number key below its first and second prefix; leading
# characters of a text key's prefixes.
KEY_SHIFTS = (42, 21)
TEXT_PREFIXES = (4, 12)
PART_DIGITS = 3      # leading hex digits of a hash that make a part (4,096 parts a group)


def _levels(df: DataFrame, key: str) -> list[Column]:
    """Monotone prefixes of the key, ending with the key itself."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.StringType):
        return [F.substring(key, 1, n) for n in TEXT_PREFIXES] + [F.col(key)]
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"first_n orders by whole numbers or text, not {kind.simpleString()}")
    return [F.shiftright(F.col(key).cast("bigint"), s) for s in KEY_SHIFTS] + [F.col(key)]


def _is(group: list[str], values: tuple) -> Column:
    same = F.lit(True)
    for g, v in zip(group, values):
        same = same & (F.col(g) == F.lit(v))
    return same


def thresholds(df: DataFrame, quotas: dict, group: list[str], key: str) -> dict:
    """Per group the last of its first ``quota`` keys: group -> (level, prefix up to
    which its rows are in).  Groups with a quota of 0 or without rows have none.

    ``quotas``: group values (a tuple) -> quota, as configured.  Up to three counting
    jobs, each of which sends one row per such group to the driver; a level's running
    sum sees the prefixes inside one prefix of the level above."""
    levels, found, inside = _levels(df, key), {}, {}
    need = {g: int(q) for g, q in quotas.items() if q > 0}
    for level, p in enumerate(levels):
        if not need:
            break
        wanted, here = F.lit(None).cast("bigint"), F.lit(False)
        for g, q in need.items():
            wanted = F.when(_is(group, g), F.lit(q)).otherwise(wanted)
            here = here | (_is(group, g) & (levels[level - 1] == F.lit(inside[g])) if level else _is(group, g))
        counts = df.filter(here).groupBy(*group, p.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
        last = (counts.withColumn("_lo", before(group, "_p", "_c")).withColumn("_need", wanted).filter("_lo < _need")
                .groupBy(*group).agg(F.max_by(F.struct("_p", "_lo", "_c"), "_p").alias("_e")))
        for r in last.select(*group, "_e.*").collect():
            g = tuple(r[c] for c in group)
            if level == len(levels) - 1 or r["_lo"] + r["_c"] <= need[g]:
                found[g] = (level, r["_p"])
                del need[g]
            else:
                inside[g], need[g] = r["_p"], need[g] - r["_lo"]
        need = {g: q for g, q in need.items() if g in inside}
    return found


def up_to(df: DataFrame, key: str, threshold: tuple | None) -> Column:
    """Whether a row's key is at or below a threshold (false where there is none)."""
    return F.lit(False) if threshold is None else _levels(df, key)[threshold[0]] <= F.lit(threshold[1])


def first_n(df: DataFrame, quotas: dict, group: list[str], key: str) -> DataFrame:
    """The rows of ``df`` that are among the first ``quota`` of their group by
    ``key`` (unique in its group): a filter; rows of groups without a quota go."""
    inside = F.lit(False)
    for g, t in thresholds(df, quotas, group, key).items():
        inside = inside | (_is(group, g) & up_to(df, key, t))
    return df.filter(inside)


def _part(hash_col: str) -> Column:
    return F.substring(hash_col, 1, PART_DIGITS)


def parts(df: DataFrame, group: list[str], hash_col: str) -> DataFrame:
    """Per group and part of a hex hash: rows and rows of the group's earlier parts."""
    counts = df.groupBy(*group, _part(hash_col).alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.withColumn("_before", before(group, "_part", "_rows"))


def before(group: list[str], order: str, count: str) -> Column:
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(w), F.lit(0))


def ranked(df: DataFrame, group: list[str], hash_col: str, out: str, wanted: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``: the row's number (from 1) in its group in the order of a hex hash.

    ``wanted`` (``group``, ``_part``, ``_before``: :func:`parts`, filtered) leaves out the parts
    that do not matter before any row is numbered."""
    wanted = parts(df, group, hash_col) if wanted is None else wanted
    w = Window.partitionBy(*group, "_part").orderBy(hash_col)
    return (df.withColumn("_part", _part(hash_col)).join(wanted.select(*group, "_part", "_before"), [*group, "_part"])
            .withColumn(out, F.col("_before") + F.row_number().over(w)).select(*df.columns, out))
