"""Periodic runs of words in documents, by repeated k-gram masking and Main-Lorentz.

A run is a stretch of words with smallest period q, at least ``exponent`` periods and
``min_length`` words long, that cannot be made longer.  It overlaps itself, moved by q
words, in at least k words, where k is the least of ``max(min_length, exponent * q) - q`` over all
q.  So each of its words lies in a k-gram that occurs twice in the document, and words
outside such k-grams can join no run.  Those are masked; the stretches that are left are divided
at their middles, and a run that crosses a middle is found from the words one period
before and after it.  Extensions are found by halving steps on prefix hashes; every run is compared
word by word at the end, and the hashes are drawn anew if one fails.

Time is n log n steps per stretch, memory is a few numbers per word.  Documents need no shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import Numbering, flat_words, refuse, slices, with_bytes

PRIMES = (2147483647, 2147483629)
#: Pairs of a middle and a period that are looked at together.
AT_ONCE = 1 << 18
OUTPUTS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def least_overlap(min_length: int, exponent: int) -> int:
    """Words in which any run overlaps itself after a move by its period."""
    return min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))


def repeated(x: np.ndarray, doc: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Which words lie in a k-gram that occurs twice in their document; hashes can only mark too many."""
    alive = np.zeros(len(x) + 1, np.int32)
    if len(x) < k:
        return alive[:-1] > 0
    rng = np.random.default_rng(seed)
    odd = rng.integers(1, 1 << 62, k + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at = len(x) - k + 1
    h = doc[:at].astype(np.uint64) * odd[k]
    for j in range(k):
        v = x[j : j + at].astype(np.uint64) * odd[j]
        h = (h ^ (v ^ (v >> np.uint64(29)))) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(h, kind="stable")
    h = h[order]
    same = h[1:] == h[:-1]
    twice = np.zeros(at, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    twice &= doc[:at] == doc[k - 1 :]
    starts = np.flatnonzero(twice)
    np.add.at(alive, starts, 1)
    np.add.at(alive, starts + k, -1)
    return np.cumsum(alive[:-1]) > 0


class Extensions:
    """How far two places of ``y`` agree, by prefix hashes modulo two primes."""

    def __init__(self, y: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.n, self.sums, self.powers = len(y), [], []
        for q in PRIMES:
            base = np.uint64(rng.integers(1 << 20, q - 1))
            powers = np.ones(1, np.uint64)
            step = base
            while len(powers) <= self.n:
                powers = np.concatenate([powers, powers * step % np.uint64(q)])
                step = step * step % np.uint64(q)
            powers = powers[: self.n + 1]
            # a drawn value per number of a word
            value = rng.integers(1, q, int(y.max()) + 1 if self.n else 1, dtype=np.uint64)[y]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers[:-1] % np.uint64(q))])
            self.sums.append((total % np.uint64(q)).astype(np.uint32))
            self.powers.append(powers.astype(np.uint32))

    def agree(self, i: np.ndarray, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the ``t`` words from ``i`` on equal those from ``i + p`` on."""
        same = np.ones(len(i), bool)
        for q, sums, powers in zip(PRIMES, self.sums, self.powers):
            q, get = np.uint64(q), lambda k, s=sums: s[k].astype(np.uint64)
            left = (get(i + t) + q - get(i)) % q * powers[p].astype(np.uint64) % q
            same &= left == (get(i + p + t) + q - get(i + p)) % q
        return same

    def forward(self, i: np.ndarray, p: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), most.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            ok = self.agree(i, p, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    def backward(self, i: np.ndarray, p: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), most.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            ok = self.agree(i - mid, p, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def _crossing(y: np.ndarray, lce: Extensions, first: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, min_length: int, exponent: int) -> Iterator[np.ndarray]:
    """(start, end, period) of stretches that cross the middles of the parts ``left`` to ``right`` of their segments ``first`` to ``end``."""
    mid = (left + right) // 2
    periods = (right - left) // exponent
    upto = np.cumsum(periods)
    at = 0
    while at < len(mid):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
        n = periods[at:to]
        for lo in range(1, int(n.max(initial=0)) + 1, AT_ONCE):  # one part alone may have more
            some = np.minimum(n - lo + 1, AT_ONCE).clip(0)
            part = np.repeat(np.arange(at, to), some)
            p = np.arange(len(part)) - np.repeat(np.cumsum(some) - some, some) + lo
            m = mid[part]
            for i in (m - p, m):
                ok = (i >= first[part]) & (i + p < end[part])
                ok[ok] = y[i[ok]] == y[i[ok] + p[ok]]
                j, q, b, e = i[ok], p[ok], first[part[ok]], end[part[ok]]
                stop = j + lce.forward(j, q, e - j - q) + q
                start = j - lce.backward(j, q, j - b)
                keep = stop - start >= np.maximum(min_length, exponent * q)
                yield np.stack([start[keep], stop[keep], q[keep]])
        at = to


def segment_runs(y: np.ndarray, first: np.ndarray, end: np.ndarray, min_length: int, exponent: int) -> np.ndarray:
    """(start, end, period) rows of all runs in the segments ``first`` to ``end`` of ``y``, by start and period."""
    if not len(first):
        return np.zeros((0, 3), np.int64)
    for seed in range(1, 1000):
        lce, found = Extensions(y, seed), [np.zeros((3, 0), np.int64)]
        f, e, left, right = first, end, first, end
        while len(left):
            found += _crossing(y, lce, f, e, left, right, min_length, exponent)
            mid = (left + right) // 2
            f, e, left, right = np.concatenate([f, f]), np.concatenate([e, e]), np.concatenate([left, mid]), np.concatenate([mid, right])
            long = right - left >= min_length
            f, e, left, right = f[long], e[long], left[long], right[long]
        s, t, p = np.concatenate(found, axis=1)
        order = np.lexsort((p, t, s))
        s, t, p = s[order], t[order], p[order]
        new = np.ones(len(s), bool)  # the least period of a stretch; others are its multiples
        new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        s, t, p = s[new], t[new], p[new]
        if all((y[a : b - q] == y[a + q : b]).all() for a, b, q in zip(s.tolist(), t.tolist(), p.tolist())):
            order = np.lexsort((p, s))
            return np.stack([s, t, p], axis=1)[order]
    raise RuntimeError("prefix hashes failed for every base")


def document_runs(texts: list[list[bytes]], min_length: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words, by start and period."""
    k = least_overlap(min_length, exponent)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    number = Numbering()
    x = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    alive = repeated(x, doc, k)
    # stretches of living words that are long enough, one behind the other
    edge = np.diff(np.concatenate([[0], alive.astype(np.int8), [0]]))
    cut = np.flatnonzero((doc[1:] != doc[:-1]) & alive[1:] & alive[:-1]) + 1 if len(x) else np.zeros(0, np.int64)
    begin, stop = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut])), np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
    long = stop - begin >= min_length
    begin, stop = begin[long], stop[long]
    size = stop - begin
    end = np.cumsum(size)
    first = end - size
    where = np.repeat(begin - first, size) + np.arange(int(size.sum()))
    runs = segment_runs(x[where], first, end, min_length, exponent)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    offset = np.cumsum(sizes) - sizes
    for s, e, p in runs.tolist():
        at = int(where[s])
        d = int(doc[at])
        out[d].append((at - int(offset[d]), e - s, p))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those of runs beyond their first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(change[:-1]).tolist()) if not gone]


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document with a period planted at its end, if its id's CRC-32 says so; without an id as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, exponent: int = 4, planted: bool = False) -> DataFrame:
    """(``id_col``, runs array of (start, length, period), text) of every row: its runs and the words that are left.

    A word is left out if a run holds it after that run's first period; words are joined by one space.  ``planted`` first
    rewrites each tenth document or so to have a period at its end.
    Null texts are empty; they and texts without runs have an empty array.  Repeated rows and null ids are
    treated row by row, and an empty table gives an empty result.
    """
    refuse((id_col,), ["runs", "text"])
    return _each(docs, id_col, text_col, min_length, exponent, planted, "runs array<struct<start: bigint, length: bigint, period: bigint>>, text string", _whole)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, exponent: int = 4, planted: bool = False) -> DataFrame:
    """(``id_col``, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): ``collapsed`` as digests.

    The four numbers are those of the longest run (ties: smallest start, then period), null without a run.
    """
    refuse((id_col,), OUTPUTS)
    return _each(docs, id_col, text_col, min_length, exponent, planted, "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string", _digest)


def _whole(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    return [{"start": s, "length": n, "period": p} for s, n, p in runs], b" ".join(collapse(words, runs)).decode("utf-8")


def _digest(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    return len(runs), s, n, p, None if n is None else 1000 * n // p, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()


def _each(docs: DataFrame, id_col: str, text_col: str, min_length: int, exponent: int, planted: bool, columns: str, row) -> DataFrame:
    if min_length < 2 or exponent < 2:
        raise ValueError("a run has two words and two periods at least")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {columns}").schema

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for part in slices(batches):
            ids = part.column(0).to_pylist()
            texts = [t.split() for t in part.column("_b").to_pylist()]
            if planted:
                texts = [rewritten(w, i) for w, i in zip(texts, ids)]
            rows = [row(w, r) for w, r in zip(texts, document_runs(texts, min_length, exponent))]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow[0].type), *(pa.array(c, t) for c, t in zip(zip(*rows), arrow.types[1:]))], schema=arrow)

    return with_bytes(docs, text_col, id_col).mapInArrow(work, schema)
