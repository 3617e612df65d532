"""Merkle manifest of a documents table with inclusion proofs, by bitmap ranks.

Every row is a leaf.  The doc_ids of each language merge into one compressed
bitmap with a popcount directory (``ranks``); a rank query gives a leaf its
coordinate without sorting the leaves.  The coordinate's upper bits are
the key of a slot array of ``FAN ** STRIDE`` nodes, its lower bits the slot; each
round reduces the slot arrays by ``STRIDE`` levels, first over the leaves of
each language, then over the languages' subroots.  Proofs come down the same way: a slot
array meets the one path from its top to the root and extends it for its own slots.
No task ever holds more than one slot array and a path.

A node is the lowercase hex SHA-256 of its inputs joined, digests as hex text; a leaf's
inputs are doc_id, source, lang, n_chars, text, each ``-`` if NULL, else its
UTF-8 byte count, ``:`` and the value.

Edge cases: NULL doc_ids come first; rows that share a doc_id (or have none) follow one
another by leaf digest, whole copies in any order; NULL lang is a language of its own, the
first; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import copies_numbered, ordinals, ranked
from .tables import crc_mod, cut, prepare

FAN, STRIDE = 8, 4
BLOCK_BITS = 3 * STRIDE
BLOCK = FAN ** STRIDE
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NODE = "g long, pos long, n long, digest string"
_PATH = "g long, pos long, left array<string>, right array<string>, subroot string, root string"
_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _field(value: Column) -> Column:
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(text: Column) -> Column:
    """The leaf of a documents row that has ``text`` in place of its own."""
    values = [F.col(c).cast("string") for c in FIELDS[:-1]] + [text]
    return F.sha2(F.concat(*map(_field, values)).cast("binary"), 256)


def tampered_digest(altered: Column) -> Column:
    """The leaf after A-Z of the text are lower-cased where ``altered`` holds, else the leaf."""
    text = F.col("text").cast("string")
    return F.when(altered, leaf_digest(F.translate(text, UPPER, LOWER))).otherwise(leaf_digest(text))


# --- coordinates ------------------------------------------------------------
def leaves(docs: DataFrame, altered: Column) -> tuple[DataFrame, DataFrame]:
    """(leaves with their language number ``g``, languages with their counts); cut."""
    prepare(docs.sparkSession)
    lang = F.col("lang").cast("string").alias("lang")
    langs = docs.groupBy(lang).agg(F.count("*").alias("n"), F.count("doc_id").alias("known"))
    langs = ordinals(langs, [F.asc_nulls_first("lang")], "g")
    rows = docs.select(lang, F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("text").cast("string")).alias("leaf"),
                       tampered_digest(altered).alias("changed"))
    known = langs.select(F.col("lang").alias("l"), "g", "n", "known")
    return cut(rows.join(known, F.col("lang").eqNullSafe(F.col("l"))).drop("lang", "l")), langs


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` (g, n, known, doc_id, ...) with ``pos``, the place of the leaf in its language."""
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    placed = cut(ranked(rows.filter("doc_id IS NOT NULL"), ["g"], "doc_id", "pos", "again")
                 .withColumn("pos", F.col("pos") + F.col("n") - F.col("known"))
                 .unionByName(rows.filter("doc_id IS NULL").withColumns({"pos": F.lit(0).cast("long"), "again": F.lit(True)})))
    # Rows that share a doc_id are ranked by their digests in the same way, whole copies numbered.
    same = placed.filter("again").withColumns({"nul": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)),
                                               "prefix": F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")})
    same = ranked(same, ["g", "nul", "id"], "prefix", "among", "copy")
    single, copied = same.filter("NOT copy").withColumn("k", F.lit(0).cast("long")), same.filter("copy")
    copied = copies_numbered(copied, ["g", "nul", "id", "prefix"], "row", "k")
    columns = [c for c in rows.columns if c != "row"]
    same = single.unionByName(copied).withColumn("pos", F.col("pos") + F.col("among") + F.col("k")).select(*columns, "pos")
    return placed.filter("NOT again").select(*columns, "pos").unionByName(same)


# --- slot arrays ------------------------------------------------------------
def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(slots: list[str], n: int) -> list[list[str]]:
    """A slot array and its reductions: STRIDE levels, or down to one node where
    the whole tree still has ``n`` nodes and they fit one array."""
    out = [slots]
    while len(out[-1]) > 1 if n <= BLOCK else len(out) <= STRIDE:
        at = out[-1]
        out.append([_hash("".join(at[i:i + FAN])) for i in range(0, len(at), FAN)])
    return out


def siblings(reduced: list[list[str]], slot: int) -> tuple[list[str], list[str]]:
    """Left and right siblings (joined) of a slot on every level of its array."""
    left, right = [], []
    for at in reduced[:-1]:
        first = slot - slot % FAN
        left.append("".join(at[first:slot]))
        right.append("".join(at[slot + 1:first + FAN]))
        slot //= FAN
    return left, right


def _array(t: pa.Table) -> tuple[pa.Table, list[str], int]:
    t = t.sort_by("pos")
    return t, t.column("digest").to_pylist(), t.column("n")[0].as_py()


def _tops(t: pa.Table) -> pa.Table:
    """The node that a slot array reduces to."""
    t, slots, n = _array(t)
    top = levels(slots, n)[-1]
    return pa.table({"g": t.column("g").slice(0, 1), "pos": pa.array([t.column("pos")[0].as_py() >> BLOCK_BITS], pa.int64()),
                     "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": pa.array(top, pa.string())})


def _extended(t: pa.Table, path: pa.Table) -> Iterator[tuple[list[str], list[str]]]:
    """The paths to the root from the slots of an array (already sorted)."""
    reduced = levels(t.column("digest").to_pylist(), t.column("n")[0].as_py())
    up_left, up_right = path.column("left")[0].as_py(), path.column("right")[0].as_py()
    for slot in range(t.num_rows):
        left, right = siblings(reduced, slot)
        yield left + up_left, right + up_right


def _paths(t: pa.Table, path: pa.Table) -> pa.Table:
    t = t.sort_by("pos")
    left, right = zip(*_extended(t, path))
    same = lambda c: pa.array([path.column(c)[0].as_py()] * t.num_rows, pa.string())
    return pa.table({"g": t.column("g"), "pos": t.column("pos"), "left": pa.array(left, pa.list_(pa.string())),
                     "right": pa.array(right, pa.list_(pa.string())), "subroot": same("subroot"), "root": same("root")})


def fold(digest: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for a, b in zip(left, right):
        digest = _hash(a + digest + b)
    return digest


def _results(t: pa.Table, path: pa.Table) -> pa.Table:
    t = t.sort_by("pos")
    changed = t.column("changed").to_pylist()
    subroot, root = path.column("subroot")[0].as_py(), path.column("root")[0].as_py()
    proof, folded = [], []
    for k, (left, right) in enumerate(_extended(t, path)):
        proof.append(_hash("".join(a + b for a, b in zip(left, right))))
        folded.append(fold(changed[k], left, right))
    return pa.table({"doc_id": t.column("doc_id"), "leaf": t.column("digest"), "subroot": pa.array([subroot] * t.num_rows, pa.string()),
                     "root": pa.array([root] * t.num_rows, pa.string()), "proof_sha256": pa.array(proof, pa.string()),
                     "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})


def _key() -> list[Column]:
    """The slot array a node belongs to."""
    return [F.col("g"), F.shiftright("pos", BLOCK_BITS)]


def _reduced(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round, and each tree's one last node (``most``: nodes of the largest tree)."""
    rounds = []
    while not rounds or most > 1:
        rounds.append(nodes)
        nodes = cut(nodes.groupBy(*_key()).applyInArrow(lambda t: _tops(t), _NODE))
        most = -(-most // BLOCK)
    return rounds, nodes


def _down(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """From the paths of the last nodes to those of the first round's slot arrays."""
    for nodes in reversed(rounds):
        paths = _meet(nodes, paths, _paths, _PATH)
    return paths


def _meet(nodes: DataFrame, paths: DataFrame, fn, schema: str) -> DataFrame:
    kinds = nodes.sparkSession.createDataFrame([], schema).toArrow().schema

    def met(t: pa.Table, path: pa.Table) -> pa.Table:
        return fn(t, path) if t.num_rows else kinds.empty_table()

    return nodes.groupBy(*_key()).cogroup(paths.groupBy("g", "pos")).applyInArrow(met, schema)


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, leaf, its language's subroot, the root,
    proof_sha256, and what folding the (by ``altered``) tampered row's leaf with the siblings gives."""
    altered = F.lit(False) if altered is None else F.coalesce(altered, F.lit(False))
    rows, langs = leaves(docs, altered)
    size = langs.agg(F.max("n").alias("most"), F.count("*").alias("langs")).first()    # two numbers
    base = cut(coordinates(rows).select("g", "pos", "n", F.col("leaf").alias("digest"), "changed", "doc_id"))
    inner, subroots = _reduced(base.select("g", "pos", "n", "digest"), size.most or 1)
    outer, root = _reduced(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"),
                                           F.lit(size.langs).cast("long").alias("n"), "digest"), size.langs)
    none = F.array().cast("array<string>")
    paths = _down(outer, root.select("g", "pos", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("digest").alias("root")))
    top = (paths.select(F.col("pos").alias("g"), "left", "right", "root").join(subroots.select("g", F.col("digest").alias("subroot")), "g")
           .select("g", F.lit(0).cast("long").alias("pos"), "left", "right", "subroot", "root"))
    return _meet(base, _down(inner[1:], top), _results, _RESULT)


def altered_third() -> Column:
    """The rows whose crc32 of the decimal doc_id is divisible by three."""
    return crc_mod(F.col("doc_id").cast("long"), 3) == 0
