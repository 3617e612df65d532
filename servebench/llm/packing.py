"""Packing documents into sequences by cutting-stock column generation.

Every document becomes token ids plus an end id and is cut into whole
sequences of ``SEQUENCE`` tokens and one rest.  The rests are the items of a
cutting-stock problem: their lengths, rounded up to ``UNIT`` tokens, form a
histogram of fixed size; a linear program over patterns (multisets of lengths
that fit a sequence) is solved by column generation, a knapsack dynamic
program pricing new patterns from the dual values.  The solution is rounded
down, what it leaves over is placed first-fit decreasing, also on lengths
alone.  Documents of each length class are ranked and the ranks dealt to the
pattern slots in order, so only the histogram (at most SEQUENCE / UNIT counts)
and the patterns ever leave the tasks.

Edge cases: NULL and empty texts are the end id alone; repeated rows are packed
as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, id_and_text, prepare
from .units import UnitCache, groups

SEQUENCE = 2048
UNIT = 8
END_ID = 1
MAX_COLUMNS = 2_000  # of the linear program; any number gives a full, valid packing

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


# --- token ids --------------------------------------------------------------
def load_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a byte-level BPE file whose ids are its ranks."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return ranks, special


class Encoder:
    """Ids as the public tokenizer file gives them (special strings are their ids)."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks, self.special = load_ranks(path)
        self.enc = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.size = np.zeros(1 + max([*ranks.values(), *self.special.values()]), np.int64)  # bytes of each id
        self.size[list(ranks.values())] = list(map(len, ranks))
        self.cache = UnitCache(self._units)

    def _units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit as little-endian 32-bit integers.

        Units that begin with one space and a non-blank and end in a non-blank are
        encoded as one text: no pretoken crosses from one into the next, so running
        byte counts say which ids are whose."""
        joined = [u for u in units if len(u) > 1 and u[0] == " " and not u[1].isspace() and not u[-1].isspace()]
        ids = self.enc.encode_to_numpy("".join(joined), disallowed_special=()).astype("<u4")
        ends = np.cumsum([len(u.encode()) for u in joined], dtype=np.int64)
        at = (4 * np.searchsorted(np.cumsum(self.size[ids]), ends, side="right")).tolist()
        flat = ids.tobytes()
        known = {u: flat[a:b] for u, a, b in zip(joined, [0, *at], at)}
        return [known[u] if u in known else self.enc.encode_to_numpy(u, disallowed_special=()).astype("<u4").tobytes() for u in units]

    def documents(self, texts: list[str]) -> Iterator[bytes]:
        for some in groups(texts):
            odd = {i for i, t in enumerate(some) if any(s in t for s in self.special)}
            plain = iter(self.cache.values([t for i, t in enumerate(some) if i not in odd]))
            for i, t in enumerate(some):
                if i in odd:
                    yield self.enc.encode_to_numpy(t, allowed_special="all").astype("<u4").tobytes()
                else:
                    yield b"".join(next(plain))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """Whole sequences and the rest of every document, with a unique ``doc_row``."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from servebench.llm import packing

        key = (tokenizer_path, pattern)
        enc = packing._ENCODERS.get(key) or packing._ENCODERS.setdefault(key, packing.Encoder(*key))
        end = np.uint32(END_ID).astype("<u4").tobytes()
        for b in batches:
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.documents(b.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, SEQUENCE):
                    part = ids[4 * at:4 * (at + SEQUENCE)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return id_and_text(docs).mapInArrow(run, PIECES)


# --- the linear program -----------------------------------------------------
def knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes 1..len(values) of greatest value within ``capacity``."""
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        k = min(c, len(values))
        total = values[:k] + best[c - np.arange(1, k + 1)]
        j = int(total.argmax())
        if total[j] > best[c - 1] + 1e-12:
            best[c], take[c] = total[j], j + 1
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if take[c]:
            pattern[take[c] - 1] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def _first_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A feasible triangular basis: a size over half a sequence goes with the
    largest smaller one that is still demanded as often, others repeat."""
    basis = np.zeros((len(sizes), len(sizes)))
    left = demand.copy()
    for k in range(len(sizes) - 1, -1, -1):
        basis[k, k] = max(1, capacity // sizes[k])
        if 2 * sizes[k] > capacity:
            fits = np.flatnonzero((sizes <= capacity - sizes[k]) & (left >= demand[k]))
            if len(fits):
                j = fits[-1]
                basis[j, k] = 1
                left[j] -= demand[k]
    return basis


def _times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Matrix by vector without threaded linear algebra (its threads can wait for
    ever in a driver that also runs a JVM)."""
    return np.einsum("ij,j->i", matrix, x)


def _inverse(upper: np.ndarray) -> np.ndarray:
    """Inverse of an upper triangular matrix by back substitution."""
    out = np.eye(len(upper))
    for k in range(len(upper) - 1, -1, -1):
        out[k] /= upper[k, k]
        out[:k] -= np.outer(upper[:k, k], out[k])
    return out


def column_generation(demand: np.ndarray, capacity: int, max_columns: int = MAX_COLUMNS) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses them (revised simplex on a
    basis of as many patterns as there are lengths)."""
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    m = len(sizes)
    basis = _first_basis(sizes + 1, demand[sizes].astype(np.int64), capacity)
    inverse = _inverse(basis)
    x = np.maximum(_times(inverse, demand[sizes].astype(float)), 0)
    for _ in range(max_columns):
        dual = inverse.sum(axis=0)
        values = np.zeros(len(demand))
        values[sizes] = np.maximum(dual, 0)
        worth, pattern = knapsack(values, capacity)
        # obj / worth bounds the program from below: stop within half a sequence of it.
        if worth <= 1 + 1e-6 or x.sum() * (1 - 1 / worth) < 0.5:
            break
        column = _times(inverse, pattern[sizes])
        ratio = np.where(column > 1e-9, x / np.where(column > 1e-9, column, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern[sizes]
        step = ratio[out]
        x = np.maximum(x - step * column, 0)
        x[out] = step
        inverse[out] /= column[out]
        rest = column.copy()
        rest[out] = 0
        inverse -= np.outer(rest, inverse[out])
    full = np.zeros((m, len(demand)), np.int64)
    full[:, sizes] = np.rint(basis.T).astype(np.int64)
    return [(full[k], float(x[k])) for k in range(m) if x[k] > 1e-9]


def plan(demand: np.ndarray, capacity: int, max_columns: int = MAX_COLUMNS) -> list[tuple[np.ndarray, int]]:
    """Whole-number patterns that use every item exactly once: (pattern, times)."""
    left = demand.astype(np.int64).copy()
    out = []
    for pattern, times in column_generation(demand, capacity, max_columns):
        used = pattern > 0
        n = min(int(times + 1e-6), int((left[used] // pattern[used]).min()))
        if n > 0:
            out.append((pattern, n))
            left -= n * pattern
    # First-fit decreasing over what rounding left (fewer items than the basis holds).
    bins: list[tuple[int, np.ndarray]] = []
    for s in range(len(left) - 1, -1, -1):
        for _ in range(int(left[s])):
            for k, (room, pattern) in enumerate(bins):
                if room >= s + 1:
                    pattern[s] += 1
                    bins[k] = (room - s - 1, pattern)
                    break
            else:
                pattern = np.zeros(len(left), np.int64)
                pattern[s] = 1
                bins.append((capacity - s - 1, pattern))
    return out + [(pattern, 1) for _, pattern in bins]


# --- assignment -------------------------------------------------------------
def slots(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """Rank ranges of each length class: (class, first rank, end rank, first sequence, per sequence)."""
    next_rank: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        for s in np.flatnonzero(pattern):
            per = int(pattern[s])
            first = next_rank.get(int(s), 0)
            next_rank[int(s)] = first + per * times
            out.append((int(s) + 1, first, first + per * times, sequence, per))
        sequence += times
    return out


def pack(pieces_: DataFrame, unit: int = UNIT, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = pieces_.sparkSession
    # Written once: the ids are made in one pass, and ranks must not change between passes.
    p = cut(pieces_.withColumn("row", F.monotonically_increasing_id())
            .withColumn("cls", F.ceil(F.col("length") / unit).cast("int"))
            .withColumn("part", F.shiftright("row", 33).cast("int")))
    whole, rest = p.filter(F.col("length") == SEQUENCE), p.filter(F.col("length") < SEQUENCE)
    # Ranks within a class: the parts' counts, added up over the parts, give each part's first
    # rank; inside (part, class) rows are numbered apart.  No class is ever sorted in one task.
    by_part = rest.groupBy("cls", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = by_part.select("cls", "part", before.alias("first"))
    ranked = (rest.withColumn("k", F.row_number().over(Window.partitionBy("cls", "part").orderBy("row")) - 1)
              .join(first, ["cls", "part"]).withColumn("rank", F.col("first") + F.col("k")))
    capacity = SEQUENCE // unit
    demand = np.zeros(capacity, np.int64)
    for r in by_part.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        demand[r.cls - 1] = r.n
    ranges = slots(plan(demand, capacity, max_columns))
    n_rest = max((seq + (end - first_) // per for _, first_, end, seq, per in ranges), default=0)
    # A rank is found in the ranges of its class by bisection in the tasks.
    table: dict[int, list[tuple[int, int, int]]] = {}
    for cls, lo, _, seq, per in ranges:
        table.setdefault(cls, []).append((lo, seq, per))
    arrays = {c: tuple(np.array(x, np.int64) for x in zip(*sorted(v))) for c, v in table.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, rank = b.column("cls").to_numpy(), b.column("rank").to_numpy()
            seq = np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                lo, start, per = arrays[int(c)]
                at = cls == c
                k = np.searchsorted(lo, rank[at], "right") - 1
                seq[at] = start[k] + (rank[at] - lo[k]) // per[k]
            yield pa.RecordBatch.from_arrays([b.column("row"), *(b.column(c) for c in _COLUMNS), pa.array(seq)],
                                             names=["row", *_COLUMNS, "sequence_id"])

    placed = ranked.select("row", *_COLUMNS, "cls", "rank").mapInArrow(place, "row long, " + PIECES + ", sequence_id long")
    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long")).drop("row")
    # Whole sequences follow, numbered by part counts in the same way.
    wholes = whole.groupBy("part").agg(F.count("*").alias("n"))
    starts = wholes.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                                    + F.lit(n_rest)).alias("first"))  # one row per part
    numbered = (whole.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("row")) - 1).join(starts, "part")
                .select(*_COLUMNS, (F.col("first") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return placed.select(*_COLUMNS, "sequence_id", "offset").unionByName(numbered)


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
