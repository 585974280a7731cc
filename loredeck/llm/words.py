"""Words of UTF-8 text as numpy arrays: boundaries, lower-cased 64-bit hashes, shingles.

A word is a run of bytes other than space and the controls 0x09 to 0x0D; A-Z count as a-z.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
PUNCTUATED = SPACE | np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64."""
    up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _BASE, pow(_BASE, -1, 1 << 64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounds(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes not in `gap`), and for each row the index of its first word (one more entry at the end)."""
    solid = ~gap[raw]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before[inner], after[inner - 1] = False, False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base up to n or more, and their inverses."""
    return _powers(max(1 << 20, 1 << int(n).bit_length()))


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], equal for equal lower-cased bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_CODES[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of `width` words; of fewer words, one hash of the whole; of none, nothing."""
    n = min(len(words), width)
    if not n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
        total = mix(total)
    return np.unique(total)


class WordTable:
    """Packed ids of words by the words' hashes: a hash table of numpy arrays, bounded in words and in ids.

    Many words are looked up at once. A full table starts anew, so memory stays bounded whatever the words are.
    """

    def __init__(self, dtype: np.dtype | str, slots: int = 1 << 22, ids: int = 1 << 24):
        self.slots, self.most = slots, ids
        self.key = np.zeros(slots, np.uint64)  # 0: free
        self.begin, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.store = np.zeros(1 << 16, dtype)
        self.words = self.used = 0

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Each word's slot, -1 if it isn't there."""
        hashed = np.maximum(hashed, np.uint64(1))
        out, left = np.full(len(hashed), -1), np.arange(len(hashed))
        slot = (hashed & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            key = self.key[slot]
            hit = key == hashed[left]
            out[left[hit]] = slot[hit]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def make_room(self, words: int) -> None:
        """Start anew if so many more words may be too many."""
        if self.words + words > self.slots // 2 or self.used > self.most:
            self.key[:] = 0
            self.words = self.used = 0

    def add(self, hashed: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Words that aren't there, each once, with the number of ids of each and the ids one after another."""
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(size) - size
        self.words, self.used = self.words + len(hashed), self.used + len(ids)
        hashed = np.maximum(hashed, np.uint64(1))
        left, slot = np.arange(len(hashed)), (hashed & np.uint64(self.slots - 1)).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.key[slot] == 0)
            free = free[np.unique(slot[free], return_index=True)[1]]  # one word takes a slot
            at, own = slot[free], left[free]
            self.key[at], self.begin[at], self.size[at] = hashed[own], begin[own], size[own]
            on = np.ones(len(left), bool)
            on[free] = False
            left, slot = left[on], (slot[on] + 1) & (self.slots - 1)

    def gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in these slots one after another, and the number of each."""
        size = self.size[slot].astype(np.int64)
        ends = np.cumsum(size)
        return self.store[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[slot] - ends + size, size)], size


def encoded(table: WordTable, hashed: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words one after another and the number of each; encode(places) gives sizes and ids of words that are new."""
    most, parts = table.slots // 2, []
    for s in range(0, len(hashed), most):
        part = hashed[s : s + most]
        table.make_room(len(part))
        slot = table.find(part)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new = missing[np.unique(part[missing], return_index=True)[1]]
            table.add(part[new], *encode(s + new))
            slot[missing] = table.find(part[missing])
        parts.append(table.gather(slot))
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([table.store[:0], *(x for x, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
