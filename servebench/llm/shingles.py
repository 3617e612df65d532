"""Word and shingle identifiers of whole chunks, vectorised.

A word's identifier is a 64-bit hash of its bytes (A-Z lower-cased), a
shingle's one of its five words' identifiers in order.  Equal strings have
equal identifiers; two differing ones collide with probability 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np

from . import chunks as K

SHINGLE = 5
STEP = 1 << 23
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHARS = K.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % (1 << 64)
    return out[:n]


_POWERS: dict[str, np.ndarray] = {"up": _powers(_BASE, 1), "down": _powers(_INVERSE, 1)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        _POWERS[kind] = _powers(_BASE if kind == "up" else _INVERSE, n)
    return _POWERS[kind][:n]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(identifier, document) of every word of the texts ``data[offs[i]:offs[i + 1]]``."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_BLANK[data]
    begins, stops = inside.copy(), inside.copy()
    edge = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
    joined = np.zeros(len(data), bool)   # the byte before belongs to the same word
    joined[1:] = inside[:-1]
    joined[edge] = False
    begins &= ~joined
    follows = np.zeros(len(data), bool)
    follows[:-1] = inside[1:]
    follows[edge - 1] = False
    stops &= ~follows
    first, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    # Sum of char * base^position, taken back to the word's own start: a hash of the bytes alone.
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CHARS[_LOWER[data]] * _power("up", len(data)), out=total[1:])
    ident = (total[end] - total[first]) * _power("down", len(data))[first]
    ident = K.mix(ident + (end - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ident, np.searchsorted(offs, first, "right") - 1


def _chain(word: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(len(word) - width + 1, np.uint64)
    for k in range(width):
        h = K.mix(h * np.uint64(0xA0761D6478BD642F) + word[k:len(word) - width + 1 + k])
    return h


def sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, bounds): the distinct shingles of document i, sorted, are
    ``shingles[bounds[i]:bounds[i + 1]]``.  Under five words the whole sequence
    is one shingle; without words there are none."""
    n_docs = len(offs) - 1
    ident, doc = words(data, offs)
    count = np.bincount(doc, minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(count)])
    out, size = [], np.zeros(n_docs, np.int64)
    all_ = _chain(ident, SHINGLE) if len(ident) >= SHINGLE else np.zeros(0, np.uint64)
    for i in range(n_docs):
        n = count[i]
        if n >= SHINGLE:
            s = np.sort(all_[at[i]:at[i + 1] - SHINGLE + 1])
            s = s[K.first_of(s)]
        elif n:
            s = _chain(ident[at[i]:at[i + 1]], int(n)) + np.uint64(n)
        else:
            continue
        out.append(s)
        size[i] = len(s)
    shingles = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return shingles, np.concatenate([[0], np.cumsum(size)])
