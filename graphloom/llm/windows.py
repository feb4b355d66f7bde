"""Word hashes, hashes of word ranges, and content-defined anchors of word windows.

Every window of ``size`` words has one anchor: the ``gram``-word gram inside it
with the smallest hash, the first of equals.  The anchor depends on the window's
words only, so equal windows have equal anchors at equal places, wherever they stand.
Consecutive windows with the same anchor form a run.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Word hashes that a worker remembers before it starts afresh, and bytes of the longest words remembered.
MEMORY, LONGEST = 100_000, 64
# An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_words: dict[bytes, int] = {}
_powers: dict[int, np.ndarray] = {}


class _Hashes(dict):
    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = h
        return h


_known = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > MEMORY:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.ones(max(n, 1 << 16), np.uint64)
        got[1:] = np.uint64(base)
        got = np.multiply.accumulate(got)
        _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranges:
    """Hashes of word ranges of one flat array of word hashes."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _power(BASE, n), out=self.sums[1:])
        self.back = _power(INVERSE, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def runs(ranges: Ranges, lengths: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows over texts laid end to end.

    Returns per run: first window's start, number of windows, anchor hash, and the text's number.
    """
    n = int(lengths.sum())
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none.astype(np.uint64), none
    at = np.arange(n - gram + 1)
    grams = ranges.hash(at, at + gram)
    width = size - gram + 1
    # the smallest of each ``width`` grams by doubling, with the first place it has
    least, place, have = grams, at, 1
    while have * 2 <= width:
        later = least[have:] < least[:-have]
        place = np.where(later, place[have:], place[:-have])
        least = np.where(later, least[have:], least[:-have])
        have *= 2
    if have < width:
        more = width - have
        later = least[more:] < least[:-more]
        place = np.where(later, place[more:], place[:-more])
    text = np.repeat(np.arange(len(lengths)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    start = np.flatnonzero(at[: len(place)] + size <= end[: len(place)])
    if not len(start):
        return none, none, none.astype(np.uint64), none
    p = place[start]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (text[start[1:]] != text[start[:-1]])])
    count = np.diff(np.r_[first, len(start)])
    return start[first], count, grams[p[first]], text[start[first]]
