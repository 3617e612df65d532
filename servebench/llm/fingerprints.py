"""Document fingerprints from modular prefix arrays of a polynomial hash.

Of a text's code points c, ``P[i] = sum of (c[j] + 1) * B**j for j < i`` modulo the
prime 2^31 - 1, for two bases.  Any span's hash is a difference of two entries divided by
a power of B, so the equality of two spans anywhere takes constant time and the longest common
extension of two positions a binary search over span lengths.

A fingerprint is the text's length and whole hash (equal texts only have equal ones), and
the ``KEPT`` least of the hashes of its spans of ``WIDTH`` code points that end at each
position (shorter ones at the start).  Two fingerprints alone tell how alike the texts
are: the least values of both together estimate the shared part of their spans.

``edited`` pairs every document with its successor by doc_id.  Documents are range-partitioned
and stream through the tasks in order, so a neighbour is the next row; only the last document of each partition
meets the first of the next one by a join.

Edge cases: NULL text is empty; NULL doc_ids come first; documents that share a doc_id follow one another
by a hash of their text, whole copies in any order; a single document succeeds itself; an empty
table gives no rows; other columns are not read; a long text is hashed in blocks of ``STEP`` code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import id_and_text, prepare

MOD = (1 << 31) - 1
BASES = (1_048_583, 1_299_709_321)
WIDTH, KEPT = 8, 64
STEP = 1 << 20

_MOD, _31, _33 = np.uint64(MOD), np.uint64(31), np.uint64(33)


def _rem(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x < 2^63."""
    x = (x & _MOD) + (x >> _31)
    x = (x & _MOD) + (x >> _31)
    return np.where(x >= _MOD, x - _MOD, x)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n, kept and doubled as needed."""
    p = _POWERS.get(base, np.ones(1, np.uint64))
    while len(p) <= n:
        p = np.concatenate([p, _rem(p * np.uint64(pow(base, len(p), MOD)))])
    _POWERS[base] = p
    return p[:n + 1]


_INVERSES = tuple(pow(b, -1, MOD) for b in BASES)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


class Prefix:
    """Prefix arrays of a sequence of code points (or of one block of it)."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = []
        for base in BASES:
            p = np.zeros(self.n + 1, np.uint64)
            terms = (codes + np.uint64(1)) * powers(base, self.n)[:self.n]
            np.cumsum((terms & _MOD) + (terms >> _31), out=p[1:])     # below 2^32 * n
            self.sums.append(_rem(p))

    def spans(self, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        """Hashes of the spans [start, end), whatever their place."""
        p = self.sums[lane]
        return _rem((p[end] + _MOD - p[start]) * powers(_INVERSES[lane], self.n)[start])

    def equal(self, start: int, other: Prefix, at: int, length: int) -> bool:
        """Whether ``length`` code points from ``start`` are those of ``other`` from ``at``."""
        for p, q, base in zip(self.sums, other.sums, BASES):
            here, there = int(p[start + length]) - int(p[start]), int(q[at + length]) - int(q[at])
            if (here * pow(base, at, MOD) - there * pow(base, start, MOD)) % MOD:
                return False
        return True

    def common(self, start: int, other: Prefix, at: int) -> int:
        """The longest common extension of position ``start`` and ``at`` of ``other``."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, at, mid) else (low, mid - 1)
        return low


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """The longest common extension of two starts, block after block."""
    at = 0
    while at < min(len(a), len(b)):
        x, y = a[at:at + STEP], b[at:at + STEP]
        n = Prefix(x).common(0, Prefix(y), 0)
        at += n
        if n < STEP:
            break
    return at


# --- fingerprints -----------------------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    """32 well-spread bits of span hashes."""
    x = (x + np.uint64(0x9E3779B9)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> _33
    x *= np.uint64(0xA0761D6478BD642F)
    return (x >> np.uint64(32)).astype(np.uint32)


def _least(values: np.ndarray) -> np.ndarray:
    """The ``KEPT`` least distinct values, sorted."""
    share = 4 * KEPT
    while len(values) > share:                           # they are among few least ones
        some = np.unique(np.partition(values, share)[:share])
        if len(some) >= KEPT:
            return some[:KEPT]
        share *= 4
    return np.unique(values)[:KEPT]


class Mark:
    """The fingerprint of the text read so far; texts that begin alike share their beginning's."""

    def __init__(self):
        self.n, self.whole, self.least = 0, [0, 0], np.zeros(0, np.uint32)
        self.tail = np.zeros(0, np.uint64)               # the last code points

    def extended(self, codes: np.ndarray) -> Mark:
        """The mark of this text followed by ``codes``."""
        out = Mark()
        out.n, out.whole, out.least, out.tail = self.n, list(self.whole), self.least, self.tail
        for at in range(0, len(codes), STEP):
            out._take(codes[at:at + STEP])
        return out

    def _take(self, block: np.ndarray) -> None:
        before = len(self.tail)
        p = Prefix(np.concatenate([self.tail, block]) if before else block)
        for lane, base in enumerate(BASES):
            here = int(p.sums[lane][-1]) - int(p.sums[lane][before])
            self.whole[lane] = (self.whole[lane] + here * pow(base, self.n - before, MOD)) % MOD
        end = np.arange(before + 1, p.n + 1)
        values = p.spans(np.maximum(end - WIDTH, 0), end, 0) << np.uint64(6)
        values |= np.minimum(end, WIDTH).astype(np.uint64)
        self.least = _least(np.concatenate([self.least, _mixed(values)]))
        self.n += len(block)
        self.tail = block[-WIDTH:] if len(block) >= WIDTH else np.concatenate([self.tail, block])[-WIDTH:]

    def __str__(self) -> str:
        return f"{self.n:x}.{self.whole[0]:08x}{self.whole[1]:08x}." + self.least.astype(">u4").tobytes().hex()

    def alike(self, other: Mark) -> float:
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        return _alike(self.least, other.least)


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    both = np.sort(np.concatenate([x, y]))
    if not len(x) or not len(y):
        return 0.0
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    looked = min(KEPT, int(new.sum()))                   # the least values of both together
    last = int(np.flatnonzero(new)[looked] if int(new.sum()) > looked else len(both))
    shared = (last - looked) / looked                    # values of both texts stand there twice
    return 2 * shared / (1 + shared)


def fingerprint(codes: np.ndarray) -> str:
    """Length, whole hash and the ``KEPT`` least span hashes, in hex."""
    return str(Mark().extended(codes))


def likeness(a: str, b: str) -> float:
    """How alike two texts are (0 to 1) by their fingerprints: twice the shared spans over the spans of both."""
    return 1.0 if a == b else _alike(*(np.frombuffer(bytes.fromhex(f.rsplit(".", 1)[1]), ">u4") for f in (a, b)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [code_points(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(c) for c in codes], pa.int64()),
                                              pa.array([fingerprint(c) for c in codes], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


# --- edited neighbours ------------------------------------------------------
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, common_chars long")
_EDGES = RESULT + ", part int, edge string, text string"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[t]) for n, t in fields], names=[n for n, _ in fields])


class Held:
    """A document on its way: its kept three quarters are marked once, for its own end and the other's."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.kept = len(text) - len(text) // 4
        codes = code_points(text)
        self.end = codes[self.kept:]
        self.begun = Mark().extended(codes[:self.kept])
        self.mark = self.begun.extended(self.end)

    def row(self, following: str, next_mark: str | Mark) -> dict:
        """The result row where the successor's text begins with ``following``."""
        text = self.text[:self.kept] + following[:len(self.text) - self.kept]
        end = code_points(text[self.kept:])
        other = self.begun.extended(end)
        near = likeness(str(self.mark), next_mark) if isinstance(next_mark, str) else self.mark.alike(next_mark)
        return {"doc_id": self.doc_id, "n_chars": len(self.text), "edited_sha256": hashlib.sha256(text.encode()).hexdigest(),
                "fingerprint": str(self.mark), "edited_fingerprint": str(other), "near_edited": self.mark.alike(other),
                "near_next": near, "common_chars": self.kept + common_prefix(self.end, end)}


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    held = None
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            now = Held(doc_id, text)
            if held is None:
                rows.append({"doc_id": doc_id, "part": part, "edge": "first", "text": text, "fingerprint": str(now.mark)})
            else:
                rows.append(held.row(text, now.mark))
            held = now
        yield _batch(rows, _EDGES)
    if held is not None:
        yield _batch([{"doc_id": held.doc_id, "part": part, "edge": "last", "text": held.text}], _EDGES)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch([Held(doc_id, text).row(following, mark) for doc_id, text, following, mark in
                      zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following", "next_mark")))], RESULT)


def edited(docs: DataFrame) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text (the last quarter
    replaced by the beginning of the next document) and how alike they are."""
    spark = docs.sparkSession
    prepare(spark)
    d = id_and_text(docs).withColumns({"mixed": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), F.asc("mixed"), F.asc("row")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = d.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    # Written once: the documents at the edges of the partitions still have to meet.
    path = scratch_path(spark, "fingerprints")
    dealt.mapInArrow(_streamed, _EDGES).write.option("compression", "zstd").parquet(path)
    done = spark.read.parquet(path)
    first, last = done.filter("edge = 'first'"), done.filter("edge = 'last'")
    parts = first.select("part")                          # a row per partition
    at = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part"))).alias("next"))
    met = (last.select("part", "doc_id", "text").join(at, "part")
           .join(first.select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("next_mark")), "next"))
    names = [f.split()[0] for f in RESULT.split(", ")]
    return done.filter("edge IS NULL").select(*names).unionByName(met.mapInArrow(_joined, RESULT))
