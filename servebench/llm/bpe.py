"""Byte-level BPE encoding and decoding with recursive queries.

In each task a DuckDB connection of its own holds the merge table (left id,
right id -> id of the joined bytes; the id is the rank).  A batch's distinct
pretokens become (word, position, token) rows; a recursive query joins
neighbours with the merge table and contracts each word's leftmost pair of
least rank until no word has a pair left; rows name their neighbour's position, so a
pass sorts nothing.  Decoding joins the ids with the
vocabulary and concatenates their bytes by an ordered aggregation.  Spark deals
the documents out; texts never leave their task.

A pretoken that is itself in the vocabulary is one token, as in the public
library.  The recursion keeps one row per token and step, so pretokens of more
than ``LONG`` bytes (their steps would add up to the square of their length)
are contracted by the same rule over a heap.

Edge cases: NULL and empty texts have no ids; special-token strings are ordinary
text; rows are never dropped.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .tables import id_and_text, prepare
from .units import UnitCache, groups, numbered

LONG = 64
WORDS_PER_QUERY = 10_000     # few enough for their rows to stay in the processor's cache

# A row is a token: its word ``w``, its position ``p``, the position ``nx`` and id ``ntok`` of the
# token after it; ``best`` is the word's pair to contract as (rank, p, nx) in one number.  Every pass
# contracts one pair in each unfinished word (the row at ``nx`` goes, its neighbours learn of it by a
# join on the word) and looks up the pairs of the rows that are left.
_CONTRACT = """
WITH RECURSIVE s(w, p, nx, tok, ntok, best) AS (
    SELECT w, p, nx, tok, ntok, best
    FROM start LEFT JOIN (SELECT w, min(m.key + (p << 16) + nx) AS best
                          FROM start JOIN merges m ON m.l = tok AND m.r = ntok GROUP BY w) USING (w)
  UNION ALL (
    WITH gone AS (SELECT w, nx, ntok FROM s WHERE p = (best & 65535)),
    n AS MATERIALIZED (
        SELECT s.w, s.p,
               CASE WHEN s.p = (best >> 16) & 65535 THEN gone.nx ELSE s.nx END AS nx,
               CASE WHEN s.p = (best >> 16) & 65535 THEN (best >> 32)::INTEGER ELSE tok END AS tok,
               CASE WHEN s.p = (best >> 16) & 65535 THEN gone.ntok
                    WHEN s.nx = (best >> 16) & 65535 THEN (best >> 32)::INTEGER ELSE s.ntok END AS ntok
        FROM s JOIN gone ON s.w = gone.w WHERE s.p <> (best & 65535)),
    c AS (SELECT w, min(m.key + (p << 16) + nx) AS best
          FROM n JOIN merges m ON m.l = tok AND m.r = ntok GROUP BY w)
    SELECT n.w, p, nx, tok, ntok, best FROM n LEFT JOIN c ON n.w = c.w))
SELECT w, list(tok ORDER BY p) AS ids, string_agg(v.bytes, '' ORDER BY p) AS bytes
FROM s JOIN vocabulary v ON v.id = tok WHERE best IS NULL GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """Encoder and decoder of one task process."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        left, right, joined = [], [], []
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(i)
        import duckdb      # needed in tasks only: the registry is imported without it

        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self._table("merges", l=pa.array(left, pa.int32()), r=pa.array(right, pa.int32()), key=pa.array(np.array(joined, np.int64) << 32))
        self._table("vocabulary", id=pa.array(list(self.ranks.values()), pa.int32()),
                    bytes=pa.array([t.hex() for t in self.ranks], pa.string()))
        self.token = {i: t for t, i in self.ranks.items()}
        self.cache = UnitCache(self._units)

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.con.register("_in", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS FROM _in")
        self.con.unregister("_in")

    def _units(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit, decoded bytes) of each unit."""
        cut = list(map(self.split, units))
        done: dict[str, tuple[bytes, bytes]] = {}
        open_words, open_bytes = [], []
        for word in set(chain.from_iterable(cut)):
            w = word.encode()
            if (i := self.ranks.get(w)) is not None:
                done[word] = (struct.pack("<I", i), self.token[i])
            elif len(w) > LONG:
                ids = heap_contract(w, self.ranks)
                done[word] = (struct.pack(f"<{len(ids)}I", *ids), b"".join(map(self.token.__getitem__, ids)))
            else:
                open_words.append(word), open_bytes.append(w)
        for k in range(0, len(open_words), WORDS_PER_QUERY):
            done.update(zip(open_words[k:k + WORDS_PER_QUERY], self._contract(open_bytes[k:k + WORDS_PER_QUERY])))
        return [done[ws[0]] if len(ws) == 1 else (b"".join(done[w][0] for w in ws), b"".join(done[w][1] for w in ws))
                for ws in cut]

    def _contract(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit, decoded bytes) of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        tok = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        pos = (np.arange(len(tok)) - np.repeat(ends - sizes, sizes)).astype(np.int32)
        last = np.zeros(len(tok), bool)
        last[ends - 1] = True
        self._table("start", w=pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)), p=pa.array(pos), nx=pa.array(pos + 1),
                    tok=pa.array(tok), ntok=pa.array(np.append(tok[1:], 0), mask=last))
        found = self.con.sql(_CONTRACT).to_arrow_table().combine_chunks()
        ids, hexes = found.column("ids").chunk(0), found.column("bytes").chunk(0)
        return zip(_slices(ids.flatten().to_numpy().astype("<u4").tobytes(), 4 * pc.list_value_length(ids).to_numpy()),
                   _slices(bytes.fromhex("".join(hexes.to_pylist())), pc.binary_length(hexes).to_numpy() // 2))

    def documents(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        for some in groups(texts, 8 << 20):
            distinct, number, sizes = numbered(some)
            ids, decoded = zip(*self.cache.of(distinct)) if distinct else ((), ())
            ends = np.cumsum(sizes)
            yield from zip(_joined(ids, number, ends), _joined(decoded, number, ends))


def _joined(values: tuple[bytes, ...], number: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The numbered values one after another, cut at the given ends."""
    column = pa.array(values, pa.large_binary()).take(pa.array(number))
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = memoryview(column.buffers()[2] or b"")
    cuts = at[np.concatenate([[0], ends])].tolist()
    return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]


def _slices(data: bytes, sizes: np.ndarray) -> list[bytes]:
    """Consecutive slices of the given sizes."""
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def heap_contract(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same rule in memory linear in the word: leftmost pair of least rank first."""
    n = len(word)
    end = list(range(1, n + 1))      # token starting at i ends before end[i]
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == stop):
            continue
        end[i], alive[j] = stop, False
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


_CODERS: dict[tuple[str, str], Coder] = {}  # kept while the worker process lives


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), decoded (bytes) of every document."""
    return _run(docs, ranks_path, pattern, "ids binary, decoded binary", pa.binary(), lambda ids, decoded: (ids, decoded))


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded bytes, made where the ids are."""
    return _run(docs, ranks_path, pattern, "ids_sha256 string, decoded_sha256 string", pa.string(),
                lambda ids, decoded: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))


def _run(docs: DataFrame, ranks_path: str, pattern: str, columns: str, kind: pa.DataType, show) -> DataFrame:
    prepare(docs.sparkSession)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from servebench.llm import bpe

        coder = bpe._CODERS.setdefault((ranks_path, pattern), None) or bpe.Coder(ranks_path, pattern)
        bpe._CODERS[ranks_path, pattern] = coder
        for b in batches:
            n, first, second = [], [], []
            for ids, decoded in coder.documents(b.column("text").to_pylist()):
                x, y = show(ids, decoded)
                n.append(len(ids) // 4), first.append(x), second.append(y)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, kind), pa.array(second, kind)],
                                             names=["doc_id", "n_tokens", *names])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, n_tokens long, {columns}")
