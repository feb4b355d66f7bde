"""Quality rules: word and line counts, and suffix-array repetition.

All texts of a slice share one suffix array over word numbers, built by prefix
doubling.  Windows of 1, 2, 4 and 8 words are ranked for all positions, which
also answers the window rule; only positions whose 8-word window occurs again in
the same text are refined further (16, 32, ... words), so clean text costs three
sorts.  Neighbours in the finished array give longest common prefixes; a position's
larger neighbour value is the deepest common-prefix interval it lies in, that is
the longest repeat starting there.  The union of these spans equals the union of
all maximal repeats, since a repeat that is not maximal lies within one that is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SLICE, SPACES, Numbering, refuse, slices, with_bytes

WINDOW = 8
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """``min_words`` and ``max_repeat_percent`` make ``base_failed``; the others are the suffix array's verdict.

    Words in 8-word repeats are common in good texts too, up to the base limit; long repeats are
    not (sf0.1: of 9,066 texts that pass the base none has one of 16 words).  So these have a
    limit of half the base's.  ``max_longest_percent`` of the words is more than a repeat without
    overlap can have below the base limit: it holds for words or lines repeated in a row.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    min_span: int = 16
    max_covered: float = 0.15
    max_longest: int = 500
    max_longest_percent: int = 15


def _dense(key: np.ndarray) -> np.ndarray:
    """Dense ranks of int64 keys."""
    order = np.argsort(key)
    k = key[order]
    new = np.empty(len(k), np.int32)
    new[order] = np.cumsum(np.r_[False, k[1:] != k[:-1]], dtype=np.int32) if len(k) else 0
    return new


class RepeatArray:
    """Suffix array with longest common prefixes over the repeated parts of many word sequences.

    ``ids`` are the word numbers of all sequences end to end, ``lengths`` the words of each.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        n = len(ids)
        self.ids, self.n = ids, n
        self.seq = np.repeat(np.arange(len(lengths)), lengths)
        self.end = np.repeat(np.cumsum(lengths), lengths)
        self.levels: list[tuple[int, np.ndarray]] = []
        at = np.arange(n)
        rank = ids.astype(np.int64)
        for k in (1, 2, 4):
            # first the sequence and the word, then pairs of ranks; 0 stands for "past the end"
            far = np.zeros(n, np.int64)
            inside = at + k < self.end
            far[inside] = rank[at[inside] + k] + 1
            if k == 4:
                # equal windows in other sequences are no repeats
                pair = _dense(rank * (n + 2) + far).astype(np.int64)
                rank = _dense(self.seq * np.int64(n + 1) + pair)
            else:
                rank = _dense(rank * (n + 2) + far).astype(np.int64)
        count = np.bincount(rank, minlength=1)
        self.tied = np.flatnonzero(count[rank] > 1) if n else np.zeros(0, np.int64)
        # a window cut off by its sequence's end is unique in it, so ties are whole windows
        start = np.cumsum(count) - count
        rank = start[rank].astype(np.int64) if n else rank
        self.levels.append((WINDOW, rank))
        self._refine(rank)
        self._prefixes()

    def _refine(self, rank: np.ndarray) -> None:
        tied, k = self.tied, WINDOW
        while len(tied):
            far = np.full(len(tied), -1, np.int64)
            inside = tied + k < self.end[tied]
            far[inside] = rank[tied[inside] + k]
            order = np.lexsort((far, rank[tied]))
            t, f, r = tied[order], far[order], rank[tied][order]
            group = np.r_[True, r[1:] != r[:-1]]
            fresh = group | np.r_[True, f[1:] != f[:-1]]
            place = np.arange(len(t))
            head = np.maximum.accumulate(np.where(group, place, 0))
            sub = np.maximum.accumulate(np.where(fresh, place, 0))
            rank = rank.copy()
            rank[t] = r + (sub - head)
            k *= 2
            self.levels.append((k, rank))
            size = np.bincount(np.cumsum(fresh) - 1)
            tied = t[size[np.cumsum(fresh) - 1] > 1]
        self.rank = rank

    def _prefixes(self) -> None:
        """``order``: tied suffixes sorted; ``lcp[i]``: common words of ``order[i-1]`` and ``order[i]``."""
        first = self.levels[0][1]
        self.order = self.tied[np.argsort(self.rank[self.tied])] if len(self.tied) else self.tied
        a, b = self.order[:-1], self.order[1:]
        same = np.flatnonzero(first[a] == first[b])
        a, b = a[same], b[same]
        got = np.zeros(len(a), np.int64)
        for k, rank in reversed(self.levels):
            # ranks of windows past a sequence's end are unique, so equality means k common words
            ok = np.flatnonzero((a + got < self.end[a]) & (b + got < self.end[b]))
            eq = ok[rank[a[ok] + got[ok]] == rank[b[ok] + got[ok]]]
            got[eq] += k
        live = np.arange(len(a))
        for _ in range(WINDOW):
            live = live[(a[live] + got[live] < self.end[a[live]]) & (b[live] + got[live] < self.end[b[live]])]
            live = live[self.ids[a[live] + got[live]] == self.ids[b[live] + got[live]]]
            got[live] += 1
        self.lcp = np.zeros(len(self.order) + 1, np.int64)
        self.lcp[1 + same] = got

    def longest_at(self) -> np.ndarray:
        """For every position the words of the longest repeat that starts there (0, or WINDOW and more)."""
        out = np.zeros(self.n, np.int64)
        if len(self.order):
            out[self.order] = np.maximum(self.lcp[:-1], self.lcp[1:])
        return out

    def covered(self, least: int) -> np.ndarray:
        """Whether each word lies in a repeat of at least ``least`` words."""
        span = self.longest_at()
        start = np.flatnonzero(span >= least)
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + span[start], -1)
        return np.cumsum(edge[:-1]) > 0

    def intervals(self, least: int = WINDOW) -> list[tuple[int, int, list[int]]]:
        """Maximal repeats as common-prefix intervals: (sequence, words, sorted starts).

        An interval is a maximal repeat if its suffixes are not all preceded by the same word.
        """
        found, stack = [], []
        for i in range(len(self.order) + 1):
            low, left = int(self.lcp[i]) if i < len(self.order) else 0, i - 1
            while stack and stack[-1][0] > low:
                words, left = stack.pop()
                starts = np.sort(self.order[left:i])
                before = {int(self.ids[p - 1]) if p and self.seq[p - 1] == self.seq[p] else -1 - int(p) for p in starts}
                if words >= least and len(before) > 1:
                    found.append((int(self.seq[starts[0]]), words, starts.tolist()))
            if low and (not stack or stack[-1][0] < low):
                stack.append((low, left))
        return found


def repeats(texts: list[bytes]) -> tuple[RepeatArray, np.ndarray]:
    """The repeat array over the words of ``texts``, and the words of each text."""
    number, lengths = Numbering(), np.zeros(len(texts), np.int64)
    parts = []
    for i, t in enumerate(texts):
        words = t.split()
        lengths[i] = len(words)
        parts.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    return RepeatArray(np.concatenate(parts) if parts else np.zeros(0, np.int64), lengths), lengths


def maximal_repeats(text: str, least: int = WINDOW) -> list[tuple[int, list[int]]]:
    """Maximal repeated word sequences of one text: (words, word positions)."""
    array, _ = repeats([text.encode()])
    return [(words, starts) for _, words, starts in array.intervals(least)]


def _sums(flags: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def judge(texts: list[bytes], limits: Limits = Limits()) -> list[np.ndarray]:
    """The columns ``COLUMNS`` for a list of texts."""
    array, n_words = repeats(texts)
    chars = np.array([len(t.decode("utf-8", "replace")) - sum(map(t.count, (SPACES[i : i + 1] for i in range(6)))) for t in texts], np.int64)
    symbols = np.array([sum(t.count(SYMBOLS[i : i + 1]) for i in range(8)) for t in texts], np.int64)
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip(SPACES)]
        dup[i] = len(lines) - len(set(lines))
    window = np.zeros(array.n + 1, np.int64)
    np.add.at(window, array.tied, 1)
    np.add.at(window, array.tied + WINDOW, -1)
    repeat = _sums(np.cumsum(window[:-1]) > 0, n_words)
    covered = _sums(array.covered(limits.min_span), n_words)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, array.seq, array.longest_at())
    failed = (n_words < limits.min_words) | (100 * repeat > limits.max_repeat_percent * n_words)
    kept = ~failed & (covered <= limits.max_covered * n_words) & (longest <= limits.max_longest) & (100 * longest <= limits.max_longest_percent * n_words)
    return [n_words, chars, symbols, dup, repeat, failed, kept, covered, longest]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``id_col`` and ``COLUMNS`` of every row.

    ``n_repeat_words`` counts words in 8-word windows found twice or more in the
    text; ``covered_words`` those in maximal repeats of ``min_span`` words or more;
    ``longest_repeat`` is in words, 0 below 8.  ``kept`` is false if
    ``base_failed``, else false if repeats cover more than ``max_covered`` of the
    words or one is longer than ``max_longest`` words or ``max_longest_percent`` of the words.  Null or blank texts have no
    words and fail.  Repeated rows and null ids are judged row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most_bytes=SLICE):
            columns = judge(b.column(1).to_pylist(), limits)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], names=[id_col, *names])

    names = [c.split()[0] for c in COLUMNS.split(", ")]
    refuse((id_col,), names)
    source = with_bytes(docs, text_col, id_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, {COLUMNS}")


def _good(batches: Iterator[pa.RecordBatch], place: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """The rows whose field number ``place``, the text, passes."""

    def beside() -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(0).field(place)
            # a view of the row's own bytes
            yield pa.RecordBatch.from_arrays([b.column(0), text.cast(pa.binary()) if pa.types.is_null(text.type) else text], names=["_row", "_b"])

    for b in slices(beside(), most_bytes=SLICE):
        texts = [t or b"" for t in b.column("_b").cast(pa.binary()).to_pylist()]
        yield b.filter(pa.array(judge(texts, limits)[6])).drop_columns(["_b"])


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` whose text passes; all columns stay as they are.

    Null, empty and blank texts do not pass; repeated rows are judged one by one; an empty table stays one.
    The text travels once, within its row.
    """
    names = docs.columns
    if text_col not in names:  # Spark finds names of another case too
        names, text_col = [c.lower() for c in names], text_col.lower()
    place = names.index(text_col)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return row.mapInArrow(lambda it: _good(it, place, limits), f"_row {row.schema['_row'].dataType.simpleString()}").select("_row.*")
