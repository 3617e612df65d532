"""Suffix-array dedup by bucket-pointer refinement.

Removes every byte covered by a 50-byte string that also starts in a document
with a smaller doc_id.  Only the first 50 bytes of suffixes matter, so the
refinement stops there, and only buckets that can still change are refined:

* Initial buckets: the identifier of the q-gram at a position (q = 26) is built
  from the identifiers of its halves at a later offset (1, 2, 4, 8, 16, then 26 =
  16 and 16 at offset 10).
* A 50-byte string is (bucket at its start, bucket at offset 24).  It is filed
  under the least q-gram inside it (its anchor), so equal strings meet under
  equal anchors, and one anchor stands for a run of neighbouring strings.
* Round 0 finds the anchor buckets that more than one document holds; all others
  are singletons and done.
* Round 1 refines the rest by the bucket identifiers at the offsets that span the
  run.  All holders of one refined bucket but the smallest doc_id are settled.
* Round 2 takes, for anchor buckets that still hold differing runs, the strings
  one by one, for the smallest holder of each run only.

Identifiers have 48 bits (two or three of them together decide rounds 1 and 2); texts are
shuffled once, a key at most once per chunk.

Edge cases: NULL text is empty; texts under 50 bytes keep everything; documents
with NULL doc_id neither lose bytes nor count as earlier; rows that share a
doc_id never remove from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as K
from .tables import id_and_bytes

WIDTH, Q = 50, 26
LATER = WIDTH - Q                # offset of the second bucket of a string
STEP = 1 << 20                   # strings looked at together
_POS = np.uint64((1 << 31) - 1)
_HIGH = ~np.uint64(0xFFFF)        # identifiers travel as their upper 48 bits
_CHARS = K.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL = np.uint64(0xD6E8FEB86659FD93)


def qgram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket identifiers of all q-grams, by doubling over later offsets."""
    h = _CHARS[data]
    for k in (1, 2, 4, 8):
        h = h[:-k] * _MUL + (h[k:] ^ (h[k:] >> np.uint64(31)))
    return K.mix(h[:-(Q - 16)] * _MUL + (h[Q - 16:] ^ (h[Q - 16:] >> np.uint64(29))))


class Runs:
    """Anchors of the strings that start in one slice of a chunk."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, doc: np.ndarray):
        base = int(starts[0])
        self.b = qgram_buckets(data[base:int(starts[-1]) + WIDTH])
        key = self.b & ~_POS | np.arange(len(self.b), dtype=np.uint64)
        for k in (1, 2, 4, 8):
            key = np.minimum(key[:-k], key[k:])
        key = np.minimum(key[:-(LATER + 1 - 16)], key[LATER + 1 - 16:])  # least of LATER + 1 q-grams
        at = starts - base
        anchor = (key[at] & _POS).astype(np.int64)
        new = K.first_of(anchor)
        new[1:] |= doc[1:] != doc[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        self.base, self.lo, self.hi = base, at[first], at[last]  # of the strings filed under each anchor
        self.anchor, self.doc = anchor[first], doc[first]
        self.bucket = self.b[self.anchor]

    def refined(self) -> tuple[np.ndarray, np.ndarray]:
        """Two identifiers of each run from the buckets at its offsets."""
        span = ((self.anchor - self.lo) << 8 | (self.hi - self.lo)).astype(np.uint64)
        four = self.b[self.lo], self.b[self.lo + LATER], self.b[self.hi], self.b[self.hi + LATER]
        out = []
        for m in (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)):
            h = span * m
            for x in four:
                h = K.mix(h + x * m)
            out.append(h)
        return out[0] & _HIGH, out[1] & _HIGH

    def strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(run, start) of every string of the chosen runs."""
        n = self.hi[chosen] - self.lo[chosen] + 1
        run = np.repeat(chosen, n)
        return run, self.lo[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


def slices(data: np.ndarray, offs: np.ndarray, known: np.ndarray) -> Iterator[Runs]:
    """The runs of a chunk, over documents with an id."""
    n = np.maximum(np.diff(offs) - (WIDTH - 1), 0) * known
    doc = np.repeat(np.arange(len(n)), n)
    starts = np.repeat(offs[:-1], n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(starts, starts[at] + STEP))
        yield Runs(data, starts[at:end], doc[at:end])
        at = end


class Chunk:
    """One chunk at whatever round its answers have reached."""

    def __init__(self, table: pa.Table, parts: tuple[int, int, int], answers: dict[str, dict[int, memoryview]]):
        self.table, self.parts, self.answers = table, parts, answers
        self.data, self.offs = K.texts(table)
        ids = table.column("doc_id").combine_chunks()
        self.known = np.array(ids.is_valid()).astype(bool)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.runs = list(slices(self.data, self.offs, self.known))

    # Round 0: which anchor buckets do several documents hold?
    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct 48-bit buckets (upper bits) and whether two documents here hold them."""
        if not self.runs:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        b = np.concatenate([r.bucket for r in self.runs]) & _HIGH
        d = np.concatenate([self.ids[r.doc] for r in self.runs])
        order = np.lexsort((d, b))
        b, d = b[order], d[order]
        new = K.first_of(b)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(b)) - 1
        return b[first], d[first] != d[last]

    def shared(self) -> list[np.ndarray]:
        """For each slice, its runs in shared buckets."""
        keys, _ = self.buckets()
        (bits,) = K.gathered_bits(keys, self.parts[0], self.answers["buckets"])
        keys = keys[bits]
        out = []
        for r in self.runs:
            b = r.bucket & _HIGH
            at = np.minimum(np.searchsorted(keys, b), max(len(keys) - 1, 0))
            out.append(np.flatnonzero(keys[at] == b) if len(keys) else np.zeros(0, np.int64))
        return out

    # Round 1: refined buckets and their smallest holder here.
    def refine(self) -> None:
        self.sel = self.shared()
        b, k1, k2, d = [], [], [], []
        for r, s in zip(self.runs, self.sel):
            x, y = r.refined()
            b.append(r.bucket[s]), k1.append(x[s]), k2.append(y[s]), d.append(self.ids[r.doc[s]])
        empty = np.zeros(0, np.uint64)
        b, k1, k2 = (np.concatenate(x) if x else empty for x in (b, k1, k2))
        d = np.concatenate(d) if d else np.zeros(0, np.int64)
        b = b & _HIGH
        order = np.lexsort((d, k2, k1, b))
        new = K.first_of(b[order]) | K.first_of(k1[order]) | K.first_of(k2[order])
        at = order[new]
        self.b, self.k1, self.k2, self.least = b[at], k1[at], k2[at], d[at]
        self.key_of = np.empty(len(b), np.int64)      # refined bucket of each shared run
        self.key_of[order] = np.cumsum(new) - 1
        self.run_doc = d

    # Round 2: the strings of the smallest holders in buckets that hold differing runs.
    def single_strings(self) -> None:
        smaller, mixed = K.gathered_bits(self.b, self.parts[1], self.answers["runs"], 2)
        self.covered = smaller[self.key_of] | (self.run_doc > self.least[self.key_of])
        again = mixed[self.key_of] & ~self.covered
        w1, w2, d, where = [], [], [], []
        at = 0
        for k, (r, s) in enumerate(zip(self.runs, self.sel)):
            run, start = r.strings(s[again[at:at + len(s)]])
            at += len(s)
            w1.append(K.mix(r.b[start] * _MUL + r.b[start + LATER]) & _HIGH)
            w2.append(K.mix(r.b[start] ^ K.mix(r.b[start + LATER])) & _HIGH)
            d.append(self.ids[r.doc[run]]), where.append(r.base + start)
        empty = np.zeros(0, np.uint64)
        w1, w2 = (np.concatenate(x) if x else empty for x in (w1, w2))
        d, where = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (d, where))
        order = np.lexsort((d, w2, w1))
        new = K.first_of(w1[order]) | K.first_of(w2[order])
        at = order[new]
        self.w1, self.w2, self.w_least = w1[at], w2[at], d[at]
        self.w_key = np.empty(len(w1), np.int64)
        self.w_key[order] = np.cumsum(new) - 1
        self.w_doc, self.w_at = d, where

    def removed(self) -> np.ndarray:
        """Which bytes of the chunk go."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        at = 0
        for r, s in zip(self.runs, self.sel):
            gone = s[self.covered[at:at + len(s)]]
            at += len(s)
            np.add.at(edge, r.base + r.lo[gone], 1)
            np.add.at(edge, r.base + r.hi[gone] + WIDTH, -1)
        (smaller,) = K.gathered_bits(self.w1, self.parts[2], self.answers["strings"])
        gone = self.w_at[smaller[self.w_key] | (self.w_doc > self.w_least[self.w_key])]
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WIDTH, -1)
        return np.cumsum(edge[:-1]) > 0


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _lengths(payloads: list[memoryview]) -> np.ndarray:
    """Keys in each payload: a 4-byte count comes first."""
    return np.array([int.from_bytes(p[:4], "little") for p in payloads], np.int64)


def _answer_buckets(payloads: list[memoryview]) -> list[bytes]:
    n = _lengths(payloads)
    keys = np.concatenate([K.from48(p[4:4 + 6 * k]) for p, k in zip(payloads, n)])
    here = np.concatenate([np.unpackbits(np.frombuffer(p[4 + 6 * k:], np.uint8), count=k) for p, k in zip(payloads, n)])
    order = np.argsort(keys, kind="stable")
    group = np.cumsum(K.first_of(keys[order])) - 1
    weight = np.bincount(group, weights=1 + here[order]) > 1
    out = np.empty(len(keys), bool)
    out[order] = weight[group]
    return [_packed(x) for x in np.split(out, np.cumsum(n)[:-1])]


def _answer_least(payloads: list[memoryview], refined: bool) -> list[bytes]:
    """Whether a smaller doc_id holds the key elsewhere; for runs also whether
    their anchor bucket holds differing runs."""
    n = _lengths(payloads)
    b, k1, k2, d = [], [], [], []
    for p, k in zip(payloads, n):
        at = 4
        if refined:
            b.append(K.from48(p[at:at + 6 * k]))
            at += 6 * k
        for out in (k1, k2):
            out.append(K.from48(p[at:at + 6 * k]))
            at += 6 * k
        d.append(K.unpack_ids(p[at:]))
    k1, k2, d = np.concatenate(k1), np.concatenate(k2), np.concatenate(d)
    b = np.concatenate(b) if refined else k1
    order = np.lexsort((d, k2, k1, b))
    bo = b[order]
    new = K.first_of(bo) | K.first_of(k1[order]) | K.first_of(k2[order])
    group = np.cumsum(new) - 1
    least = d[order][new][group]
    smaller = np.empty(len(d), bool)
    smaller[order] = least < d[order]
    lanes = [smaller]
    if refined:
        bucket = np.cumsum(K.first_of(bo)) - 1
        mixed = np.empty(len(d), bool)
        mixed[order] = (np.bincount(bucket, weights=new) > 1)[bucket]
        lanes.append(mixed)
    ends = np.cumsum(n)[:-1]
    return [b"".join(_packed(x) for x in xs) for xs in zip(*(np.split(lane, ends) for lane in lanes))]


def _count(n: int) -> bytes:
    return int(n).to_bytes(4, "little")


def _answered(docs: DataFrame):
    """The chunks, their parts and the answers of the three rounds."""
    corpus = K.corpus(docs)
    parts = (corpus.parts(K.CHUNK_BYTES // 12), corpus.parts(K.CHUNK_BYTES // 20), corpus.parts(K.CHUNK_BYTES // 8))

    def round0(chunk: int, table: pa.Table, got: dict) -> Iterator[pa.RecordBatch]:
        keys, several = Chunk(table, parts, got).buckets()
        yield from K.questions(chunk, keys, parts[0], lambda i, j: _count(j - i) + K.high48(keys[i:j]) + _packed(several[i:j]))

    def round1(chunk: int, table: pa.Table, got: dict) -> Iterator[pa.RecordBatch]:
        c = Chunk(table, parts, got)
        c.refine()
        yield from K.questions(chunk, c.b, parts[1], lambda i, j: _count(j - i) + K.high48(c.b[i:j]) + K.high48(c.k1[i:j])
                               + K.high48(c.k2[i:j]) + K.pack_ids(c.least[i:j]))

    def round2(chunk: int, table: pa.Table, got: dict) -> Iterator[pa.RecordBatch]:
        c = Chunk(table, parts, got)
        c.refine()
        c.single_strings()
        yield from K.questions(chunk, c.w1, parts[2], lambda i, j: _count(j - i) + K.high48(c.w1[i:j]) + K.high48(c.w2[i:j])
                               + K.pack_ids(c.w_least[i:j]))

    answers = {"buckets": corpus.answer(corpus.each(round0, K.ASK), _answer_buckets)}
    answers["runs"] = corpus.answer(corpus.each(round1, K.ASK, answers), lambda p: _answer_least(p, True))
    answers["strings"] = corpus.answer(corpus.each(round2, K.ASK, answers), lambda p: _answer_least(p, False))
    return corpus, parts, answers


def _finish(table: pa.Table, parts, got) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, its bytes, which of them go) for every document of a chunk."""
    c = Chunk(table, parts, got)
    c.refine()
    c.single_strings()
    gone = c.removed()
    for i in range(len(c.offs) - 1):
        yield i, c.data[c.offs[i]:c.offs[i + 1]], gone[c.offs[i]:c.offs[i + 1]]


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    corpus, parts, answers = _answered(id_and_bytes(docs))

    def last(chunk: int, table: pa.Table, got: dict) -> Iterator[pa.RecordBatch]:
        rows = []
        for _, data, gone in _finish(table, parts, got):
            n = int(gone.sum())
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
            rows.append((len(data), n, spans, hashlib.sha256(data[~gone].tobytes() if n else data.tobytes()).hexdigest()))
        a, b, c, d = zip(*rows)
        yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                          pa.array(c, pa.int64()), pa.array(d, pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return corpus.each(last, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", answers)


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with every other column as it is and ``text`` without the removed
    bytes (a character cut by a removal goes whole)."""
    names = docs.columns
    src = docs.withColumns({"text": F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"),
                            "doc_id": F.col("doc_id").cast("long")})
    corpus, parts, answers = _answered(src)
    schema = ", ".join(f"`{n}` " + ("string" if n == "text" else t) for n, t in src.dtypes)

    def last(chunk: int, table: pa.Table, got: dict) -> Iterator[pa.RecordBatch]:
        text = [data[~gone].tobytes().decode("utf-8", "ignore") for _, data, gone in _finish(table, parts, got)]
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if n == "text" else table.column(n).combine_chunks() for n in names], names=names)

    return corpus.each(last, schema, answers)
