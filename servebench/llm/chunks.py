"""Corpus chunks and keyed questions about them.

Operators that compare all documents with all others work on *chunks*: a few
megabytes of consecutive documents, compressed, written once to the shared
folder and dealt out by chunk.  A round asks about 64-bit keys: each chunk sends
its distinct keys, packed and split by key range (``part``), each part answers
all chunks that asked, and the chunk meets its answers again in a co-grouped
pass.  A key that very many documents hold is sent at most once per chunk, so
no task gathers a row per document of a hot group, and texts are shuffled once.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut, free, prepare

_LIBC = ctypes.CDLL(None)
CHUNK_BYTES = 2 << 20        # text of a chunk; a longer document is a chunk of its own
PART_KEYS = 2 << 20          # keys a part is meant to answer
ASK = "part int, chunk long, payload binary"
ANSWER = "chunk long, part int, payload binary"
_ASK = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])


def _blob(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as w:
        for b in batches:
            w.write_batch(b)
    return zstandard.compress(sink.getvalue(), 3)


def read_blob(blob: bytes | memoryview) -> pa.Table:
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(blob)
    return pa.ipc.open_stream(pa.py_buffer(raw)).read_all()


def _pack(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    size = seq = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, size, seq
        out = pa.RecordBatch.from_arrays([pa.array([task << 32 | seq], pa.int64()), pa.array([_blob(held)], pa.binary())],
                                         names=["chunk", "blob"])
        held, size, seq = [], 0, seq + 1
        return out

    for b in batches:
        text = b.column("text")
        sizes = np.cumsum([0] + [len(t.as_buffer()) if t.is_valid else 0 for t in text])
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + chunk_bytes - size, "right")) - 1)
            held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, end - at)]) for c in b.columns], schema=b.schema))
            size += int(sizes[end] - sizes[at])
            at = end
            if size >= chunk_bytes or at < b.num_rows:
                yield flush()
    if held:
        yield flush()


@dataclass
class Corpus:
    """Chunks of a documents table, cut and dealt out by chunk."""
    df: DataFrame
    n_chunks: int
    partitions: int

    def parts(self, keys_per_chunk: int) -> int:
        """How many parts to split the keys into, from the number of chunks."""
        return max(self.partitions, math.ceil(self.n_chunks * keys_per_chunk / PART_KEYS))

    def each(self, fn: Callable[[int, pa.Table, dict], Iterator[pa.RecordBatch]], schema: str,
             answers: dict[str, DataFrame] | None = None) -> DataFrame:
        """``fn(chunk, documents, answers by round and part)`` over all chunks."""
        if not answers:
            def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("blob")):
                        yield from fn(chunk, read_blob(blob.as_buffer()), {})
                        _given_back(None)
            return self.df.mapInArrow(alone, schema)

        free(self.df.sparkSession)
        told, names = None, list(answers)
        for name, a in answers.items():
            a = a.withColumn("round", F.lit(name))
            told = a if told is None else told.unionByName(a)

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            got: dict[str, dict[int, memoryview]] = {name: {} for name in names}
            for name, part, payload in zip(right.column("round").to_pylist(), right.column("part").to_pylist(), right.column("payload")):
                got[name][part] = memoryview(payload.as_buffer())
            out = [x for chunk, blob in zip(left.column("chunk").to_pylist(), left.column("blob"))
                   for x in fn(chunk, read_blob(blob.as_buffer()), got)]
            return _given_back(pa.Table.from_batches(out) if out else empty)

        empty = self.df.sparkSession.createDataFrame([], schema).toArrow()
        return self.df.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(both, schema)

    def answer(self, asked: DataFrame, fn: Callable[[list[memoryview]], list[bytes]], keep: bool = True) -> DataFrame:
        """``fn`` sees the payloads of one part and returns an answer for each; cut, unless
        they are read once (``keep`` false), when they need not lie on disk twice."""
        def run(t: pa.Table) -> pa.Table:
            payloads = [memoryview(p.as_buffer()) for p in t.column("payload")]
            return _given_back(pa.Table.from_arrays([t.column("chunk").combine_chunks(), t.column("part").combine_chunks(),
                                                     pa.array(fn(payloads), pa.binary())], schema=_ANSWER))

        answers = asked.groupBy("part").applyInArrow(run, ANSWER)
        return cut(answers) if keep else answers


def _given_back(out):
    """Give the memory of a finished chunk back to the machine: Python workers stay
    for the stages to come, beside each other in an executor."""
    pa.default_memory_pool().release_unused()
    _LIBC.malloc_trim(0)
    return out


def corpus(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Corpus:
    """Pack ``docs`` (``text`` binary, any further columns) into chunks of ``chunk_bytes`` of text."""
    spark = docs.sparkSession
    prepare(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.mapInArrow(lambda batches: _pack(batches, chunk_bytes), "chunk long, blob binary")
    # Planned without runtime re-planning, the written chunks are known to be dealt by chunk,
    # so later passes do not shuffle the texts again.
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = cut(packed.repartition(partitions, "chunk"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    n = df.count()
    return Corpus(df, n, partitions)


# --- payloads ---------------------------------------------------------------
def texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of the ``text`` column of a chunk."""
    col = table.column("text").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) and col.num_chunks else col
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def split(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the key ranges of the parts begin in sorted uint64 ``keys``."""
    bounds = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]]).astype(np.int64)


def questions(chunk: int, keys: np.ndarray, parts: int, payload: Callable[[int, int], bytes]) -> Iterator[pa.RecordBatch]:
    """One row per part that has keys; ``payload(begin, end)`` packs a range of the sorted keys."""
    at = split(keys, parts)
    used = np.flatnonzero(at[1:] > at[:-1])
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), chunk), pa.int64()),
                                          pa.array([payload(int(at[p]), int(at[p + 1])) for p in used], pa.binary())], schema=_ASK)


def gathered_bits(keys: np.ndarray, parts: int, answers: dict[int, memoryview], lanes: int = 1) -> list[np.ndarray]:
    """The ``lanes`` bits answered for each of the sorted keys."""
    at = split(keys, parts)
    out = [np.zeros(len(keys), bool) for _ in range(lanes)]
    for p, a in answers.items():
        lo, n = at[p], at[p + 1] - at[p]
        each = -(-n // 8)
        for k in range(lanes):
            out[k][lo:lo + n] = np.unpackbits(np.frombuffer(a[k * each:(k + 1) * each], np.uint8), count=n).astype(bool)
    return out


def high48(keys: np.ndarray) -> bytes:
    """The upper six bytes of uint64 keys."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def from48(data: memoryview) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.reshape(-1).view("<u8")


def pack_ids(ids: np.ndarray) -> bytes:
    """Longs in four bytes each where their range allows, else in eight."""
    low = int(ids.min()) if len(ids) else 0
    narrow = len(ids) == 0 or int(ids.max()) - low < 1 << 32
    head = low.to_bytes(8, "little", signed=True) + bytes([narrow])
    return head + ((ids - low).astype("<u4") if narrow else ids.astype("<i8")).tobytes()


def unpack_ids(data: memoryview) -> np.ndarray:
    low = int.from_bytes(data[:8], "little", signed=True)
    return np.frombuffer(data[9:], "<u4").astype(np.int64) + low if data[8] else np.frombuffer(data[9:], "<i8")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def first_of(sorted_keys: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new
