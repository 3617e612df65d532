"""Language-model scoring by prediction by partial matching.

The symbols are all bytes (A-Z lower-cased) and the end of a text.  The trie of
contexts up to ``order`` symbols is counted over all training documents; the
order grows with the training texts (``order_for``).  A symbol unseen after a
context is escaped to the next shorter one with the chance of method C (distinct
symbols over occurrences plus distinct symbols), and the symbols seen after the
longer context are excluded there; below order 0 every symbol not yet excluded
is equally likely.  Since the trie is fixed when documents are scored, these
rules give one probability per (context, symbol); a document's code length is the
sum over its bytes and its end, accumulated in the tasks.

Contexts of up to two symbols are a table of at most SYMBOLS ** 3 entries, fixed by
the byte alphabet; the driver keeps the rows of the contexts that occur.  Longer
contexts are rows: each chunk sends its distinct (context, symbol) with their
training counts, dealt by the last three symbols of the context, so a part holds
all longer contexts that end in these with what they escape to.  It adds the
counts, works out the chances, and each chunk gets those it asked for.  The parts
take ``TURNS`` turns: a turn's questions and answers become a sum per document
before the next turn asks, so only one turn's lie on disk at a time.

Edge cases: NULL and empty texts code their end alone; a NULL doc_id is neither
held out nor learned from; with nothing to learn from, all symbols are equally
likely and the base counts are 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as K
from . import counts as C
from . import shingles as S
from .tables import crc_mod, cut, id_and_bytes

ORDER = 2                     # of the contexts kept as a table; longer ones are rows
SYMBOLS = 231                 # the end of a text, 256 bytes without A-Z
SIZE = SYMBOLS ** (ORDER + 1)
LONGEST = 7                   # symbols of a context that fit a 64-bit key with the symbol after it
GROW_BITS = 5                 # one symbol more of context for so many doublings of the training text
TURNS = 4                     # ranges of the long contexts asked about one after the other
CHUNK_BYTES = 16 * K.CHUNK_BYTES  # text that asks once about a key its documents share
PIECE = 1 << 21               # symbols of a chunk looked at together; a longer document is a piece of its own
BLOCK_BITS = 12, 20           # of the places of identifiers numbered together
PART_BITS, PART_MIX = 24, 0x9E3779  # the last three symbols of a context, dealt out by an odd multiplier
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
END = np.uint64(0x5851F42D4C957F2D)  # the identifier of the end token among words


# --- the model --------------------------------------------------------------
_SYMBOL = np.concatenate([np.arange(1, 66), np.arange(72, 98), np.arange(66, 231)]).astype(np.uint8)[_LOWER]  # of every byte


def order_for(symbols: int) -> int:
    """The longest context counted when so many symbols are learned from."""
    return min(max(ORDER + 1, int(symbols).bit_length() // GROW_BITS), LONGEST)


def _placed(symbols: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with ``order`` zeros before and an end after each; which places hold a symbol or an end, and their document."""
    n = np.diff(offs)
    shown = np.repeat(np.tile([False, True, False], len(n)), np.stack([np.full(len(n), order), n, np.ones(len(n), np.int64)], axis=1).ravel())
    padded = np.zeros(len(shown), np.uint8)
    padded[shown] = symbols
    shown[np.cumsum(n + order + 1) - 1] = True
    return padded, shown, np.repeat(np.arange(len(n), dtype=np.int32), n + order + 1)


def grams(symbols: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context of ORDER symbols and symbol as one number, document) of every symbol and end of the texts."""
    padded, shown, doc = _placed(symbols, offs, ORDER)
    padded, size = padded.astype(np.int32), max(0, len(padded) - ORDER)
    g = np.zeros(size, np.int32)
    for k in range(ORDER + 1):
        g *= SYMBOLS
        g += padded[k:k + size]
    return g[shown[ORDER:]], doc[shown]


def long_grams(symbols: np.ndarray, offs: np.ndarray, order: int, turn: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(context of ``order`` symbols and symbol as one key, document) of every symbol and end of the texts, or those of one turn.

    The upper bits hold the last three symbols of the context, mixed; the lower
    ones its earlier symbols, the nearest first, and the symbol after it.  Sorted
    keys are in the order of the trie at every length of context from three.
    """
    padded, shown, doc = _placed(symbols, offs, order)
    size = max(0, len(padded) - order)
    back = [padded[order - k:order - k + size] for k in range(order + 1)]     # the symbols k before every place from ``order`` on
    near = back[3].astype(np.uint32)
    for k in (2, 1):
        near *= np.uint32(SYMBOLS)
        near += back[k]
    near *= np.uint32(PART_MIX)
    near &= np.uint32((1 << PART_BITS) - 1)
    mine = shown[order:]
    if turn is not None:
        mine = mine & (near * np.uint32(TURNS) >> np.uint32(PART_BITS) == turn)
    at = np.flatnonzero(mine)
    rest = [*range(4, order + 1), 0]
    keys = near[at].astype(np.uint64) << np.uint64(64 - PART_BITS - 8 * len(rest))
    for k in rest:
        keys <<= np.uint64(8)
        keys |= back[k][at]
    return keys, doc[order:][at]


def _numbers(ident: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each ``ident`` among the distinct ``keys``, which hold them all.

    A block's identifiers are sorted by a hash that tells the keys apart, with
    their places in its lower bits: plain numbers sort several times faster than
    places by number.
    """
    low, high = BLOCK_BITS
    bits = min(62 - 2 * len(keys).bit_length(), high)       # few hashes fall together
    if bits < low:
        return np.searchsorted(keys, ident)
    step, place, factor = 1 << bits, np.uint64((1 << bits) - 1), 0x9E3779B97F4A7C15
    while True:
        hashed = keys * np.uint64(factor) & ~place
        by = np.argsort(hashed)
        hashed = hashed[by]
        if K.first_of(hashed).all():
            break
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)     # two keys fell together
    by = by.astype(np.int32)
    number = np.empty(len(ident), np.int32)
    for k in range(0, len(ident), step):
        block = ident[k:k + step] * np.uint64(factor) & ~place
        block |= np.arange(len(block), dtype=np.uint64)
        block.sort()
        of = block & ~place
        new = K.first_of(of)
        which = by[np.searchsorted(hashed, of[new])]
        number[k:k + len(block)][block & place] = which[np.cumsum(new) - 1]
    return number


def chances(count: np.ndarray) -> list[np.ndarray]:
    """Chance of each symbol after each context, by length of context from 0, from a dense table of counts."""
    levels = [count.reshape(-1, SYMBOLS).astype(np.float64)]     # longest contexts first
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(SYMBOLS, -1, SYMBOLS).sum(axis=0))
    p = [np.full((1, SYMBOLS), 1.0 / SYMBOLS)]                   # order -1
    for n in reversed(levels):
        longer = np.empty(n.shape)
        for r in range(0, len(n), 1 << 14):
            rows = np.arange(r, min(r + (1 << 14), len(n)))
            longer[rows] = _with_escape(n[rows], p[-1][rows % len(p[-1])])
        p.append(longer)
    return p[1:]


def log_probabilities(count: np.ndarray, other: int) -> np.ndarray:
    """log10 of the chances after the longest contexts of a dense table (float32), the last symbol's shared by ``other``."""
    p = np.log10(np.maximum(chances(count)[-1], 1e-30))
    p[:, SYMBOLS - 1] -= math.log10(max(1, other))
    return p.astype(np.float32).ravel()


def _with_escape(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Chances after contexts with counts ``n`` from those after the contexts one symbol shorter."""
    seen = n > 0
    total, distinct = n.sum(axis=1, keepdims=True, dtype=np.float64), seen.sum(axis=1, keepdims=True)
    left = np.where(seen, 0.0, shorter)             # exclusion: symbols seen here are no choice below
    mass = left.sum(axis=1, keepdims=True)
    may_escape = mass > 0
    whole = np.maximum(total + np.where(may_escape, distinct, 0), 1)
    escape = np.where(distinct == 0, 1.0, np.where(may_escape, distinct / whole, 0.0))
    return n / whole + escape * left / np.where(may_escape, mass, 1)


class Short:
    """Chances after contexts of up to ORDER symbols: rows of the contexts that occur, else of the one shorter."""

    def __init__(self, count: np.ndarray):
        p = chances(count)
        occurs = count.reshape(-1, SYMBOLS).any(axis=1)
        shorter = len(p[-2])
        self.rows = np.concatenate([p[-2], p[-1][occurs]])
        self.row = np.where(occurs, shorter + np.cumsum(occurs) - 1, np.arange(len(occurs)) % shorter)

    def after(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.rows[self.row[context], symbol]


def long_chances(keys: np.ndarray, n: np.ndarray, order: int, short: Short) -> np.ndarray:
    """Chance of each of the sorted distinct ``keys`` of ``long_grams``, with their training counts ``n``.

    All keys that share the last three symbols of their context must be there.
    """
    rest_bits = 64 - PART_BITS
    near = ((keys >> np.uint64(rest_bits)) * np.uint64(pow(PART_MIX, -1, 1 << PART_BITS)) % np.uint64(1 << PART_BITS)).astype(np.int64)
    head, rest = keys >> np.uint64(rest_bits), (keys & np.uint64((1 << rest_bits) - 1)).astype(np.int64)
    symbol = rest & 255
    p = short.after(near % SYMBOLS ** ORDER, symbol)
    for k in range(ORDER + 1, order + 1):
        earlier = rest >> 8 * (order - k + 1)
        new = K.first_of(head)
        new[1:] |= earlier[1:] != earlier[:-1]
        context = np.cumsum(new) - 1
        size = int(context[-1]) + 1
        pair = context * SYMBOLS + symbol
        by = np.argsort(pair, kind="stable")
        first = K.first_of(pair[by])
        number = np.empty(len(keys), np.int64)
        number[by] = np.cumsum(first) - 1
        one = by[first]                                   # a key of each (context, symbol)
        count, of, shorter = np.bincount(number, weights=n), context[one], p[one]
        seen = count > 0
        total, distinct = np.bincount(of, weights=count, minlength=size), np.bincount(of[seen], minlength=size)
        # Exclusion: what the shorter context leaves for the symbols not seen here.
        left = np.maximum(1 - np.bincount(of[seen], weights=shorter[seen], minlength=size), 1e-300)
        whole = np.maximum(total + np.where(distinct < SYMBOLS, distinct, 0), 1)
        escape = np.where(distinct > 0, distinct / whole / left, 1)
        p = np.where(seen, count / whole[of], shorter * escape[of])[number]
    return p


# --- counting ---------------------------------------------------------------
class Docs:
    """A chunk's texts and which of its documents are learned from."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.data, self.offs = K.texts(table)
        self.held_out = np.array(table.column("held_out").to_pylist(), bool)
        self.train = np.array(table.column("train").to_pylist(), bool)

    def symbols(self) -> np.ndarray:
        return _SYMBOL[self.data]

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, symbols, offsets) of about ``PIECE`` symbols and ends each."""
        places, a = self.offs + np.arange(len(self.offs)), 0
        while a < len(self.offs) - 1:
            b = max(a + 1, int(np.searchsorted(places, places[a] + PIECE, "right")) - 1)
            offs = self.offs[a:b + 1]
            yield a, self.data[offs[0]:offs[-1]], offs - offs[0]
            a = b

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(identifier, document) of all words and ends."""
        def of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ident, doc = S.words(data, offs)
            n = len(offs) - 1
            return np.concatenate([ident, np.full(n, END)]), np.concatenate([doc, np.arange(n)]).astype(np.int32)

        return self._joined(of)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens, their training counts, each token's number and document."""
        return self._distinct(*self.tokens())

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct tokens and their training counts."""
        return self._counts(*self.tokens())

    def long_grams(self, order: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``distinct`` for contexts of ``order`` symbols with the symbol after them, of one turn."""
        return self._distinct(*self._long(order, turn))

    def long_counts(self, order: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``counts`` for the same."""
        return self._counts(*self._long(order, turn))

    def _long(self, order: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        return self._joined(lambda data, offs: long_grams(_SYMBOL[data], offs, order, turn))

    def _joined(self, of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        ident, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for first, data, offs in self.pieces():
            i, d = of(data, offs)
            ident.append(i)
            doc.append(d + np.int32(first))
        return np.concatenate(ident), np.concatenate(doc)

    def _counts(self, ident: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        learned = self.train[doc]
        ours, others = ident[learned], ident[~learned]
        ours.sort()
        at = np.flatnonzero(K.first_of(ours))
        keys, count = ours[at], np.diff(at, append=len(ours))
        others.sort()
        others = others[K.first_of(others)]
        at = np.searchsorted(keys, others)
        unseen = np.append(keys, np.uint64(0))[at] != others
        unseen |= at == len(keys)
        return np.insert(keys, at[unseen], others[unseen]), np.insert(count, at[unseen], 0)

    def _distinct(self, ident: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys = np.sort(ident)
        keys = keys[K.first_of(keys)]
        number = _numbers(ident, keys)
        return keys, np.bincount(number[self.train[doc]], minlength=len(keys)), number, doc


def _sparse(counts: np.ndarray, salt: int, first: int = 0) -> Iterator[pa.RecordBatch]:
    """Non-zero counts from block ``first`` on, one row per first symbol: places (4 bytes), counts (8 bytes)."""
    width = SIZE // SYMBOLS
    for k in range(len(counts) // width):
        part = counts[k * width:(k + 1) * width]
        at = np.flatnonzero(part)
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + k], pa.int32()), pa.array([salt % C.SALTS], pa.int32()),
                 pa.array([at.astype("<u4").tobytes() + part[at].astype("<i8").tobytes()], pa.binary())],
                names=["block", "salt", "n"])


def _unsparse(blob: memoryview) -> tuple[np.ndarray, np.ndarray]:
    k = len(blob) // 12
    return np.frombuffer(blob[:4 * k], "<u4"), np.frombuffer(blob[4 * k:], "<i8")


def _add_sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, block = np.zeros(SIZE // SYMBOLS, np.int64), 0
    for b in batches:
        for k, x in zip(b.column("block").to_pylist(), b.column("n")):
            block = k
            at, n = _unsparse(memoryview(x.as_buffer()))
            total[at] += n
    yield from _sparse(total, 0, block)


def train(corpus: K.Corpus) -> np.ndarray:
    """How often each symbol follows each context of ORDER symbols in the training documents."""
    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = None
        for b in batches:
            for blob in b.column("blob"):
                n = np.zeros(SIZE, np.int64) if n is None else n
                d = Docs(K.read_blob(blob.as_buffer()))
                for first, data, offs in d.pieces():
                    g, doc = grams(_SYMBOL[data], offs)
                    g = np.sort(g[d.train[first + doc]])
                    at = np.flatnonzero(K.first_of(g))
                    n[g[at]] += np.diff(at, append=len(g))
        if n is not None:
            yield from _sparse(n, TaskContext.get().partitionId())

    by_salt = corpus.df.mapInArrow(count_grams, C.SCHEMA).groupBy("block", "salt").applyInArrow(_add_sparse, C.SCHEMA)
    count = np.zeros(SIZE, np.int64)
    for r in by_salt.groupBy("block").applyInArrow(_add_sparse, C.SCHEMA).collect():  # at most SIZE places
        at, n = _unsparse(memoryview(bytes(r.n)))
        count[r.block * (SIZE // SYMBOLS) + at.astype(np.int64)] = n
    return count


# --- scoring ----------------------------------------------------------------
def _answer_words(payloads: list[memoryview]) -> list[bytes]:
    """First the part's distinct and total training tokens, then each key's count."""
    asked = [_unpack(p) for p in payloads]
    n = [len(keys) for keys, _ in asked]
    keys, count = (np.concatenate(x) for x in zip(*asked))
    order = np.argsort(keys, kind="stable")
    group = np.cumsum(K.first_of(keys[order])) - 1
    total = np.zeros(group[-1] + 1, np.int64)
    np.add.at(total, group, count[order])
    out = np.empty(len(keys), np.int64)
    out[order] = total[group]
    head = np.array([(total > 0).sum(), total.sum()], "<i8").tobytes()
    return [head + _planes(x.astype("<i8")) for x in np.split(out, np.cumsum(n)[:-1])]


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte of all, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def _from_planes(blob: memoryview, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack(keys: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted keys as their differences, and counts."""
    k = _planes(np.diff(keys.astype("<u8"), prepend=np.uint64(0)))
    return len(k).to_bytes(4, "little") + k + _planes(count.astype("<i8"))


def _unpack(payload: memoryview) -> tuple[np.ndarray, np.ndarray]:
    k = 4 + int.from_bytes(payload[:4], "little")
    return np.cumsum(_from_planes(payload[4:k], "<u8"), dtype=np.uint64), _from_planes(payload[k:], "<i8")


def _answer_grams(payloads: list[memoryview], order: int, short: Short) -> list[bytes]:
    """The log10 chance of each key, as compressed floats."""
    asked = [_unpack(p) for p in payloads]
    n = [len(keys) for keys, _ in asked]
    keys, count = (np.concatenate(x) for x in zip(*asked))
    by = np.argsort(keys, kind="stable")
    new = K.first_of(keys[by])
    p = long_chances(keys[by][new], np.add.reduceat(count[by], np.flatnonzero(new)), order, short)
    out = np.empty(len(keys), "<f4")
    out[by] = np.log10(p)[np.cumsum(new) - 1]
    return [zstandard.compress(x.tobytes(), 6) for x in np.split(out, np.cumsum(n)[:-1])]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        heads = [np.frombuffer(x.as_buffer()[:16], "<i8") for x in b.column("payload")]
        yield pa.RecordBatch.from_arrays([pa.array([int(h[k]) for h in heads], pa.int64()) for k in (0, 1)], names=["v", "n"])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    held = crc_mod(F.col("doc_id").cast("long"), 10) == 0
    src = id_and_bytes(docs).withColumns({"held_out": F.coalesce(held, F.lit(False)), "train": F.coalesce(~held, F.lit(False))})
    corpus = K.corpus(src, CHUNK_BYTES)
    count = train(corpus)
    order = order_for(int(count.sum()))
    model = spark.sparkContext.broadcast(Short(count))  # at most SIZE floats
    parts, gram_parts = corpus.parts(CHUNK_BYTES // 32), corpus.parts(CHUNK_BYTES // 4)

    def ask(chunk: int, t: pa.Table, got: dict) -> Iterator[pa.RecordBatch]:
        keys, count = Docs(t).counts()
        yield from K.questions(chunk, keys, parts, lambda i, j: _pack(keys[i:j], count[i:j]))

    def turn_sums(turn: int) -> DataFrame:
        """A row per chunk: the sum of its documents' log10 chances over the turn's keys."""
        def ask_grams(chunk: int, t: pa.Table, got: dict) -> Iterator[pa.RecordBatch]:
            keys, count = Docs(t).long_counts(order, turn)
            yield from K.questions(chunk, keys, gram_parts, lambda i, j: _pack(keys[i:j], count[i:j]))

        def add(chunk: int, t: pa.Table, got: dict) -> Iterator[pa.RecordBatch]:
            d = Docs(t)
            grams_, _, gram, of = d.long_grams(order, turn)
            at = K.split(grams_, gram_parts)
            log10 = np.zeros(len(grams_))
            for p, a in got["grams"].items():
                log10[at[p]:at[p + 1]] = np.frombuffer(zstandard.decompress(a), "<f4")
            sums = np.bincount(of, weights=log10[gram], minlength=len(d.offs) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([turn], pa.int32()),
                                              pa.array([sums.astype("<f8").tobytes()], pa.binary())], names=["chunk", "part", "payload"])

        told = corpus.answer(corpus.each(ask_grams, K.ASK), lambda payloads: _answer_grams(payloads, order, model.value), keep=False)
        return cut(corpus.each(add, K.ANSWER, {"grams": told}))

    words = corpus.answer(corpus.each(ask, K.ASK), _answer_words)
    sums = words.dropDuplicates(["part"]).mapInArrow(_totals, "v long, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    distinct, total = sums.v or 0, sums.n or 0
    turns = {f"turn {k}": turn_sums(k) for k in range(TURNS)}
    names = list(turns)

    def run(chunk: int, t: pa.Table, got: dict) -> Iterator[pa.RecordBatch]:
        d = Docs(t)
        n_docs = len(d.offs) - 1
        keys, _, number, doc = d.distinct()
        at = K.split(keys, parts)
        count = np.zeros(len(keys), np.int64)
        for p, a in got["words"].items():
            count[at[p]:at[p + 1]] = _from_planes(a[16:], "<i8")
        logs = np.log10((count + 0.1) / (total + 0.1 * (distinct + 1)))
        scores = sum(np.frombuffer(a, "<f8") for name in names for a in got[name].values())
        yield pa.RecordBatch.from_arrays(
            [t.column("doc_id").combine_chunks(), pa.array(d.held_out),
             pa.array(np.bincount(doc, minlength=n_docs)), pa.array(np.bincount(doc, weights=(count > 0)[number], minlength=n_docs).astype(np.int64)),
             pa.array(np.full(n_docs, total)), pa.array(np.bincount(doc, weights=logs[number], minlength=n_docs)),
             pa.array(scores)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return corpus.each(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
                       {"words": words} | turns)
