"""Cutting texts where no pretoken of the public byte-level pattern can cross.

A single space between two non-blank characters always starts a new match of
the pattern, so a text may be cut before each of them and the parts ("units")
tokenised on their own.  Units repeat, so a bounded cache answers most of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# A text where every space stands alone between non-blank characters can be cut with str.split.
_ODD = regex.compile(r"\s\s|^\s|\s\Z")
# The same for a whole column; it may find more than _ODD, whose blanks are all among these.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MAYBE_ODD = rf"{_BLANK}{{2}}|\A{_BLANK}|{_BLANK}\z"
_CUT = regex.compile(r"(?<=\S)(?= \S)")
MAX_CACHED = 600_000


def units(text: str) -> list[str]:
    """The units of a text; joined they are the text."""
    if not text:
        return []
    if _ODD.search(text) is None:
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]]
    return [u for u in _CUT.split(text) if u]


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units of the texts, the number of every unit and how many units each text has.

    Where every space stands alone the texts are cut and their words numbered as one column."""
    column = pa.array(texts, pa.large_string())
    odd = pc.match_substring_regex(column, _MAYBE_ODD)
    words = pc.split_pattern(column.filter(pc.invert(odd)), " ")
    plain = ~odd.to_numpy(zero_copy_only=False)
    begins = words.offsets.to_numpy()
    coded = words.flatten().dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64) * 2 + 1       # odd: with a space before it
    number[begins[:-1]] -= 1
    known = coded.dictionary.to_pylist()
    seen = np.bincount(number, minlength=2 * len(known)) > 0
    distinct = [" " + known[k >> 1] if k & 1 else known[k >> 1] for k in np.flatnonzero(seen).tolist()]
    number = (np.cumsum(seen) - 1)[number]
    sizes = np.zeros(len(texts), np.int64)
    sizes[plain] = np.diff(begins)
    if plain.all():
        return distinct, number, sizes
    cut = [units(texts[i]) for i in np.flatnonzero(~plain)]
    sizes[~plain] = list(map(len, cut))
    place = {u: i for i, u in enumerate(distinct)}
    others = np.array([place.setdefault(u, len(place)) for us in cut for u in us], np.int64)
    out = np.empty(len(number) + len(others), np.int64)
    is_plain = np.repeat(plain, sizes)
    out[is_plain], out[~is_plain] = number, others
    return list(place), out, sizes


class UnitCache:
    """unit -> value, filled in batches by ``encode``; emptied when it holds ``limit`` units."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = MAX_CACHED):
        self.encode, self.limit, self.known = encode, limit, {}

    def of(self, distinct: list[str]) -> list:
        """The values of distinct units, in order."""
        missing = [u for u in distinct if u not in self.known]
        if len(self.known) + len(missing) > self.limit:
            self.known = {u: self.known[u] for u in distinct if u in self.known}
        if missing:
            self.known.update(zip(missing, self.encode(missing)))
        return list(map(self.known.__getitem__, distinct))

    def values(self, texts: list[str]) -> list[list]:
        """For each text the values of its units, in order."""
        cut = [units(t) for t in texts]
        missing = set()
        for u in cut:
            missing.update(u)
        if len(self.known) + len(missing) > self.limit:
            self.known = {u: self.known[u] for u in missing if u in self.known}
        missing.difference_update(self.known)
        if missing:
            new = list(missing)
            self.known.update(zip(new, self.encode(new)))
        get = self.known.__getitem__
        return [list(map(get, u)) for u in cut]


def groups(texts: list[str], limit: int = 4 << 20):
    """Consecutive texts of about ``limit`` characters together (a longer text alone)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]
