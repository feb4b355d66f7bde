"""Repeated passages found with compressed FM-indexes.

A window is ``size`` consecutive words of a document.  A word is removed if a
window over it also starts in a document with a smaller id.

1. Each document lists the anchors of its windows (see ``windows``).  Only anchors
   that occur in two documents can stand in a repeated window.
2. Documents with such anchors give their runs of windows, and equal runs become one
   with the smallest id that has it.
3. Runs are dealt out by anchor, so all places of a window meet in one shard.  Each
   shard is indexed: suffix array, Burrows-Wheeler transform, and a wavelet matrix with
   packed bits and block counts.  The runs are streamed through the index by
   backward search, all in step.  At ``size`` matched words the interval of the
   suffix array is the set of places of the window; it is reported with the
   smallest id among them.  Then the match drops its last word (the interval widens
   to its neighbours with ``size`` - 1 common words) and goes on.
4. The reported intervals go back to the documents through joins on the run.

The text is shuffled once by document: the joins of steps 2 and 4 share the exchange.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import kept
from .windows import Ranges, runs, word_hashes
from .words import SLICE, Numbering, flat_words, refuse, release, slices

#: Words that a shard's index holds before the next anchor opens another.
SHARD_WORDS = 1 << 19
WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")


# ------------------------------------------------------------ the index
class WaveletMatrix:
    """Symbols as packed bit vectors, one per bit of the symbols, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n, self.levels = len(symbols), max(1, int(top).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.zeros.append(int(self.n - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(top + 1)
        self.origin = np.zeros(top + 1, np.int64)
        self.origin = self._walk(every, np.zeros(top + 1, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            block = at >> 6
            ones = self.counts[i][block] + np.bitwise_count(self.bits[i][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.levels - 1 - i) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol[i]`` occurs before ``at[i]``."""
        return self._walk(symbol, at) - self.origin[symbol]


class FMIndex:
    """FM-index over word sequences, with the neighbour data for windows of ``size`` words."""

    def __init__(self, texts: list[list[bytes]], owner: np.ndarray, size: int):
        number = Numbering()
        number[b""] = 0
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        n = int(lengths.sum()) + len(texts)
        self.size, self.lengths = size, lengths
        text = np.zeros(n, np.int64)
        self.end = np.cumsum(lengths + 1) - 1
        for words, to in zip(texts, self.end):
            text[to - len(words) : to] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.text, top = text, len(number) - 1
        # separators differ from each other, so no common prefix crosses one
        rank = text + len(texts)
        rank[self.end] = np.arange(len(texts))
        want = {k: None for k in self._parts(size)} | {k: None for k in self._parts(size - 1)}
        k, unique = 1, False
        while True:
            order = np.argsort(rank if k == 1 else key)
            sorted_key = (rank if k == 1 else key)[order]
            step = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = step
            if k in want:
                want[k] = rank
            unique = unique or int(step[-1]) == n - 1
            if unique and all(w is not None or j < k for j, w in want.items()):
                break
            if unique:
                # longer windows are all distinct as well
                for j in want:
                    if j > k:
                        want[j] = rank
                break
            far = np.zeros(n, np.int64)
            far[: n - k] = rank[k:] + 1
            key = rank * (n + 1) + far
            k *= 2
        sa = order
        self.equal = lambda words: self._equal(sa, want, words)
        less, full = self.equal(size - 1), self.equal(size)
        self.low = np.maximum.accumulate(np.where(less, 0, np.arange(n)))
        last = np.r_[~less[1:], True]
        self.high = np.minimum.accumulate(np.where(last, np.arange(n), n)[::-1])[::-1] + 1
        starts = np.flatnonzero(~full)
        group = np.cumsum(~full) - 1
        in_text = np.repeat(np.arange(len(texts)), lengths + 1)
        self.least = np.minimum.reduceat(owner[in_text[sa]], starts)[group]
        bwt = text[sa - 1]
        bwt[sa == 0] = 0
        self.tree = WaveletMatrix(bwt, top)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=top + 1))[:-1]]

    @staticmethod
    def _parts(words: int) -> list[int]:
        return [1 << i for i in range(words.bit_length()) if words >> i & 1]

    def _equal(self, sa: np.ndarray, ranks: dict[int, np.ndarray], words: int) -> np.ndarray:
        """Whether suffix i shares its first ``words`` words with suffix i - 1."""
        n, a, b = len(sa), sa[:-1], sa[1:]
        ok, at = np.ones(n - 1, bool), 0
        for k in reversed(self._parts(words)):
            pa_, pb = np.minimum(a + at, n - 1), np.minimum(b + at, n - 1)
            ok &= (ranks[k][pa_] == ranks[k][pb]) & (a + at < n) & (b + at < n)
            at += k
        return np.r_[False, ok]

    def matches(self, windows: np.ndarray) -> np.ndarray:
        """For the first ``windows[i]`` windows of each indexed text, flat: the smallest owner among their places."""
        size, tree, before = self.size, self.tree, self.before
        ends = np.cumsum(windows)
        found = np.zeros(int(windows.sum()), np.int64)
        lane = np.argsort(-self.lengths, kind="stable")
        length = self.lengths[lane]
        begin = self.end[lane] - length
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), len(self.text), np.int64)
        for step in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -step, side="left"))  # lanes with more than ``step`` words
            lo, hi = lo[:live], hi[:live]
            at = length[:live] - 1 - step
            symbol = self.text[begin[:live] + at]
            both = tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
            lo, hi = before[symbol] + both[:live], before[symbol] + both[live:]
            if step >= size - 1:
                own = at < windows[lane[:live]]
                found[(ends - windows)[lane[:live][own]] + at[own]] = self.least[lo[own]]
                hi = self.high[hi - 1]
                lo = self.low[lo]
        return found


def _search(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, run, least, windows, words) sorted by anchor -> (anchor, run, least per window)."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        index = FMIndex([r[4].split() for r in rows], np.array([r[2] for r in rows], np.int64), size)
        windows = np.array([r[3] for r in rows], np.int64)
        least = index.matches(windows)
        offsets = np.r_[0, np.cumsum(windows)].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(least))], names=["_a", "_run", "_least"])

    rows: list[tuple] = []
    words = 0
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if words >= SHARD_WORDS and r[0] != rows[-1][0]:
                yield shard(rows)
                rows, words = [], 0
            rows.append(r)
            words += r[3] + size
    if rows:
        yield shard(rows)
    rows = []
    release()


# ------------------------------------------------------------ documents
def _anchors(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most_bytes=SLICE):
        words, lengths = flat_words(b.column("_b").to_pylist())
        _, _, anchor, doc = runs(Ranges(word_hashes(words)), lengths, size, gram)
        order = np.lexsort((anchor, doc))
        a, d = anchor[order], doc[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])] if len(a) else np.zeros(0, bool)
        row = pa.array(d[first])
        yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), b.column("_id").take(row), b.column("_th").take(row), b.column("_tk").take(row)], names=["_a", "_id", "_th", "_tk"])


def _runs(batches: Iterator[pa.RecordBatch], size: int, gram: int, texts: bool) -> Iterator[pa.RecordBatch]:
    """Runs with wanted anchors; ``texts``: their words, once per task, else where they stand."""
    seen: set[tuple[int, int]] = set()
    for b in slices(batches, most_bytes=SLICE):
        words, lengths = flat_words(b.column("_b").to_pylist())
        ranges = Ranges(word_hashes(words))
        start, count, anchor, doc = runs(ranges, lengths, size, gram)
        wanted = [np.array(x, np.int64).view(np.uint64) for x in b.column("_wanted").to_pylist()]
        edges = np.searchsorted(doc, np.arange(len(lengths) + 1))
        hit = np.concatenate([np.isin(anchor[i:j], w) for i, j, w in zip(edges[:-1], edges[1:], wanted)]) if len(wanted) else np.zeros(0, bool)
        start, count, anchor, doc = start[hit], count[hit], anchor[hit].view(np.int64), doc[hit]
        run = ranges.hash(start, start + count + size - 1).view(np.int64)
        base = (np.cumsum(lengths) - lengths)[doc]
        if texts:
            ids = b.column("_id").to_pylist()
            least: dict[tuple[int, int], list] = {}
            for a, r, s, n, d in zip(anchor.tolist(), run.tolist(), start.tolist(), count.tolist(), doc.tolist()):
                if (got := least.get((a, r))) is None:
                    least[a, r] = [ids[d], n, s]
                elif ids[d] < got[0]:
                    got[0] = ids[d]
            out = []
            for (a, r), (i, n, s) in least.items():
                new = (a, r) not in seen
                seen.add((a, r))
                out.append((a, r, i, n, b" ".join(words[s : s + n + size - 1]) if new else None))
            if len(seen) > 1 << 20:
                seen.clear()
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["_a", "_run", "_min", "_n", "_words"])
        else:
            row = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(run), b.column("_id").take(row), b.column("_th").take(row), b.column("_tk").take(row), pa.array(start - base)], names=["_a", "_run", "_id", "_th", "_tk", "_at"])


def _spans(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Occurrences with the smallest id per window -> word spans to remove."""
    for b in batches:
        if not b.num_rows:
            continue
        lists = b.column("_least")
        flat, off = np.asarray(lists.flatten()), np.asarray(lists.offsets)
        off = off - off[0]
        n = np.diff(off)
        row = np.repeat(np.arange(len(n)), n)
        bad = flat < np.asarray(b.column("_id"))[row]
        at = np.asarray(b.column("_at"))[row] + np.arange(len(row)) - off[:-1][row]
        row, at = row[bad], at[bad]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]) if len(row) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(row)] - 1 if len(first) else first
        who = pa.array(row[first])
        yield pa.RecordBatch.from_arrays([b.column("_th").take(who), b.column("_tk").take(who), pa.array(at[first]), pa.array(at[last] + size if len(first) else first)], names=["_th", "_tk", "_from", "_to"])


def _keys(row_id, text) -> list:
    """``_id``, ``_b`` and two hashes of both that stand for the document in joins; they are never null."""
    return [row_id.alias("_id"), F.xxhash64(row_id, text).alias("_th"), F.xxhash64(F.lit(1), row_id, text).alias("_tk"), text.alias("_b")]


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, gram: int = 10) -> tuple[DataFrame, DataFrame]:
    """(``keyed``, ``spans``): the documents with keys ``_th``, ``_tk``, their ``_id`` and bytes ``_b``, and per key the word spans to remove."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    keyed = docs.select(*_keys(F.col(f"`{id_col}`").cast("long"), text))
    anchors = kept(keyed.where("_id IS NOT NULL").mapInArrow(lambda it: _anchors(it, size, gram), "_a long, _id long, _th long, _tk long"))
    shared = anchors.groupBy("_a").agg(F.min("_id").alias("_x"), F.max("_id").alias("_y")).where("_x < _y").select("_a")
    wanted = kept(anchors.join(shared, "_a").groupBy("_th", "_tk").agg(F.collect_list("_a").alias("_wanted")))
    found = keyed.join(wanted, ["_th", "_tk"])
    texts = found.mapInArrow(lambda it: _runs(it, size, gram, True), "_a long, _run long, _min long, _n long, _words binary")
    distinct = texts.groupBy("_a", "_run").agg(F.min("_min").alias("_min"), F.first("_n").alias("_n"), F.first("_words", ignorenulls=True).alias("_words"))
    least = distinct.repartition("_a").sortWithinPartitions("_a", "_run").mapInArrow(lambda it: _search(it, size), "_a long, _run long, _least array<long>")
    places = found.mapInArrow(lambda it: _runs(it, size, gram, False), "_a long, _run long, _id long, _th long, _tk long, _at long")
    hits = places.join(least, ["_a", "_run"]).select("_id", "_th", "_tk", "_at", "_least").mapInArrow(lambda it: _spans(it, size), "_th long, _tk long, _from long, _to long")
    return keyed, hits.groupBy("_th", "_tk").agg(F.collect_list(F.struct("_from", "_to")).alias("_spans"))


def _mask(n: int, spans: list[dict]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["_from"]] += 1
        edge[s["_to"]] -= 1
    return np.cumsum(edge[:-1]) == 0


def without(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of ``spans`` and the white space before each."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    keep = _mask(len(words), spans)
    out, at = [], 0
    for (a, b), ok in zip(words, keep.tolist()):
        if ok:
            out.append(text[at:b])
        at = b
    return b"".join(out) + text[at:]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    """(``id_col``, n_words, n_removed, kept_sha256) of every row.

    Ids are integers; a null id is no smaller id to others and loses nothing.  Null
    texts have no words.  Rows repeated with the same id do not remove each other's
    words, as neither id is smaller.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, gone, sha = [], [], []
            for text, spans in zip(b.column("_b").to_pylist(), b.column("_spans").to_pylist()):
                words = text.split()
                n = len(words)
                if spans:
                    words = [w for w, ok in zip(words, _mask(n, spans).tolist()) if ok]
                total.append(n)
                gone.append(n - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    refuse((id_col,), ["n_words", "n_removed", "kept_sha256"])
    keyed, spans = removed_spans(docs, id_col, text_col, size)
    return keyed.join(spans, ["_th", "_tk"], "left").mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text_col``; all rows and other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text = [without(t, s) if s else t for t, s in zip(b.column("_b").to_pylist(), b.column("_spans").to_pylist())]
            yield b.set_column(b.schema.get_field_index("_b"), "_b", pa.array(text, pa.binary())).drop_columns(["_spans"])

    _, spans = removed_spans(docs, id_col, text_col, size)
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row"), F.col(f"`{text_col}`").isNull().alias("_null"), *_keys(F.col(f"`{id_col}`").cast("long"), text))
    joined = packed.join(spans, ["_th", "_tk"], "left").select("_row", "_null", "_b", "_spans")
    kind = packed.schema["_row"].dataType.simpleString()
    out = joined.mapInArrow(run, f"_row {kind}, _null boolean, _b binary")
    new = F.when(F.col("_null"), F.lit(None)).otherwise(F.col("_b").cast("string"))
    return out.select(*[new.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
