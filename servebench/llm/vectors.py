"""Embedding near-dedup with a pivot-permutation index.

A vector is described by its ``PREFIX`` nearest of ``PIVOTS`` reference points, in
order of distance; close vectors order the points alike.  The index is the
inverted list of each (label, pivot); vectors that share at least ``SHARED``
pivots of their prefixes are candidates, and every candidate pair is verified
by its cosine in double precision.  A pair is counted in the list of the
lowest pivot it shares and nowhere else.

Lists longer than ``BLOCK`` vectors are split into blocks and dealt out as pairs
of blocks, so a third of all vectors in one list is many tasks of bounded
size.  A task gives each vector its number of links and, for the components,
the least vector reachable inside the task: pairs are never emitted.

The pivots are ``PIVOTS`` vectors of the table (smallest hash of vec_id first), a
documented bounded sample; every vector is indexed.

Edge cases: NULL, zero, NULL-holding or non-finite vectors and NULL labels link
with nothing; vectors of different length never link; repeated rows (one
vec_id) count as one vector each and share its component; a NULL vec_id keeps
a row without component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import cut, prepare

PIVOTS, PREFIX, SHARED = 64, 8, 2
COSINE = 0.98
BLOCK = 2048

_ROWS = "vec_id long, label long, mask long, unit binary"


def _usable(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                       F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()
                    & ~F.coalesce(bad, F.lit(False)) & F.exists("e", lambda x: x != 0))


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _filled(pivots: np.ndarray | None, length: int) -> np.ndarray:
    """Always ``PIVOTS`` points: those missing for a rare vector length are drawn at random."""
    drawn = np.random.default_rng(length).normal(size=(PIVOTS, length))
    drawn /= np.sqrt((drawn * drawn).sum(axis=1, keepdims=True))
    return drawn if pivots is None else np.concatenate([pivots, drawn])[:PIVOTS]


def _describe(pivots: dict[int, np.ndarray]):
    """Unit vectors and the bit mask of each one's nearest pivots (of its own length)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, rows = (b.column(c).to_pylist() for c in ("vec_id", "label", "e"))
            mask, blob = [0] * len(rows), [b""] * len(rows)
            by_len: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                by_len.setdefault(len(r), []).append(i)
            for n, at in by_len.items():
                x = _unit([rows[i] for i in at])
                p = _filled(pivots.get(n), n)
                near = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :PREFIX]
                bits = np.bitwise_or.reduce(np.uint64(1) << near.astype(np.uint64), axis=1).view(np.int64)
                for i, m, u in zip(at, bits.tolist(), x):
                    mask[i], blob[i] = m, u.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(mask, pa.int64()),
                                              pa.array(blob, pa.binary())], names=["vec_id", "label", "mask", "unit"])
    return run


def _block_pair(pivot: int, x: pa.Table, y: pa.Table | None, shared: int, cosine: float):
    """Links between two blocks of a list (or inside one): counts and least reachable."""
    def arrays(t):
        return (np.array(t.column("vec_id").to_pylist(), np.int64), np.array(t.column("mask").to_pylist(), np.int64).view(np.uint64),
                t.column("unit").to_pylist())
    ids, mask, units = arrays(x)
    n = len(ids)
    if y is not None:
        i2, m2, u2 = arrays(y)
        ids, mask, units = np.concatenate([ids, i2]), np.concatenate([mask, m2]), units + u2
    count = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    size = np.array(list(map(len, units)))
    low = np.uint64((1 << pivot) - 1)
    edges = []
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        vec = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), -1)
        left = np.flatnonzero(at < n)
        right = left if y is None else np.flatnonzero(at >= n)
        for k in range(0, len(left), 256):
            i = left[k:k + 256]
            common = mask[at[i]][:, None] & mask[at[right]][None, :]
            cand = (np.bitwise_count(common) >= shared) & ((common & low) == 0)
            if y is None:
                cand &= i[:, None] < right[None, :]
            a, b = np.nonzero(cand)
            ok = np.einsum("ij,ij->i", vec[i[a]], vec[right[b]]) >= cosine
            a, b = at[i[a[ok]]], at[right[b[ok]]]
            np.add.at(count, a, 1)
            np.add.at(count, b, 1)
            edges.append((a, b))
    a = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, np.int64)
    b = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.int64)
    rank = np.empty(len(ids), np.int64)   # label propagation on the order of vec_ids
    order = np.argsort(ids, kind="stable")
    rank[order] = np.arange(len(ids))
    root = rank.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = np.minimum(root, root[order[root]])
        if (root == before).all():
            break
    return ids, count, ids[order[root]]


def links(vectors: DataFrame, cosine: float = COSINE, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, least (a vector of the same component): one row per vector and task."""
    spark = vectors.sparkSession
    prepare(spark)
    usable = _usable(vectors)
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()  # bounded: the reference points
    by_len: dict[int, list] = {}
    for r in sample:
        by_len.setdefault(len(r.e), []).append(r.e)
    described = cut(usable.mapInArrow(_describe({n: _unit(rows) for n, rows in by_len.items()}), _ROWS))
    bits = F.filter(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda k: F.call_function("getbit", F.col("mask"), k) == 1)
    lists = described.withColumn("pivot", F.explode(bits))
    sizes = lists.groupBy("label", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # A block meets every block of its list once, and itself.
    dealt = (lists.join(sizes, ["label", "pivot"]).withColumn("own", F.pmod(F.xxhash64("vec_id", "unit"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
             .select("label", "pivot", "i", "j", "own", "vec_id", "mask", "unit"))

    def run(t: pa.Table) -> pa.Table:
        i, j, pivot = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("pivot")[0].as_py()
        own = np.array(t.column("own").to_pylist())
        x, y = t, None
        if i != j:
            x, y = t.take(np.flatnonzero(own == i)), t.take(np.flatnonzero(own == j))
        ids, count, least = _block_pair(pivot, x, y, shared, cosine)
        some = count > 0
        return pa.table({"vec_id": pa.array(ids[some]), "n_links": pa.array(count[some]), "least": pa.array(least[some])})

    return dealt.groupBy("label", "pivot", "i", "j").applyInArrow(run, "vec_id long, n_links long, least long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    found = cut(links(vectors, cosine))
    count = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    comp = components(found.select(F.col("vec_id").alias("a"), F.col("least").alias("b")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
            .join(count, "vec_id", "left").join(comp.withColumnRenamed("node", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("root", "vec_id").alias("component_id"),
                    F.coalesce(F.coalesce("root", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept")))
