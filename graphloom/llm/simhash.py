"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints are computed where the documents are read.  Distinct fingerprints
are dealt out by pigeonhole keys: the 64 bits are cut into ``max_diff + 2``
blocks, and two fingerprints that differ in at most ``max_diff`` bits agree on
two blocks at least, so every linked pair shares one of the block-pair keys.
Within a task the fingerprints of each key are sorted by Gray rank and indexed:
consecutive codes form nodes that hold the bit pattern shared below them
(a mask and a value), a node's own mask leaves out what an upper node already
holds, and a search adds up the differences on the way down and prunes a whole
group as soon as they exceed the limit, or as soon as group and query are known
to be in the same component.  Tasks return spanning stars instead of pairs; the
stars are contracted to components with DataFrame joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import contract, kept
from .confirm import classes, shingle_sets
from .lossless import similar_texts
from .words import only, refuse, release, slices, with_bytes

SEED = 42
FANOUT = 8
#: Query-node pairs that a search holds at once.
FRONTIER = 1 << 20


# ------------------------------------------------------------ fingerprints
def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) word shingles, repeats included; no word: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n - shingle + 1)
    counts = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(``_id``, ``_h``, ``_fp``) of every row: its id, its text's MD5 and the fingerprint's bits; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column("_b").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["_id", "_h", "_fp"])

    source = with_bytes(only(docs, _id=id_col, _t=text_col), "_t", "_id").select("_id", F.md5("_b").alias("_h"), "_b")
    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, _h string, _fp long")


# ------------------------------------------------------------ the index
def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the binary reflected Gray sequence."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchical index over codes of many buckets, each sorted by Gray rank.

    ``levels[0]`` are the leaves (the codes themselves).  Each level has, per
    node: ``mask``/``value`` (the pattern shared by all codes below), ``own``
    (the mask without what the parent's mask holds) and ``first``/``last``, the
    node's children in the level below.  The top level has one node per bucket.
    """

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), bucket))
        self.order, self.codes = order, codes[order]
        b = bucket[order]
        full = np.full(len(codes), ~np.uint64(0), np.uint64)
        levels = [{"mask": full, "value": self.codes, "bucket": b}]
        while True:
            low = levels[-1]
            b = low["bucket"]
            starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
            if len(starts) == len(b):
                break
            within = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
            first = np.flatnonzero(within % FANOUT == 0)
            same = np.bitwise_and.reduceat(low["mask"], first)
            ones, any_ = np.bitwise_and.reduceat(low["value"], first), np.bitwise_or.reduceat(low["value"], first)
            mask = same & ~(ones ^ any_)
            levels.append({"mask": mask, "value": ones & mask, "bucket": b[first], "first": first, "last": np.r_[first[1:], len(b)]})
        for low, up in zip(levels, levels[1:]):
            low["own"] = low["mask"] & ~np.repeat(up["mask"], up["last"] - up["first"])
        levels[-1]["own"] = levels[-1]["mask"]
        self.levels = levels
        top = levels[-1]["bucket"]
        self.root = np.searchsorted(top, levels[0]["bucket"])

    def components(self, max_diff: int) -> np.ndarray:
        """For each code in index order, the first position of its component within its bucket."""
        n = len(self.codes)
        label = np.arange(n)
        at, step = 0, 32
        while at < n:
            q = np.arange(at, min(n, at + step))
            at += step
            a, b = self._links(q, label, max_diff)
            if len(a):
                label = _merge(label, a, b)
            step = min(step * 2, 1 << 15)
        return label

    def _links(self, q: np.ndarray, label: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of queries to codes of other components so far."""
        lows, highs = [label], [label]
        for up in self.levels[1:]:
            lows.append(np.minimum.reduceat(lows[-1], up["first"]))
            highs.append(np.maximum.reduceat(highs[-1], up["first"]))
        found_a, found_b = [], []
        stack = [(len(self.levels) - 1, q, self.root[q], np.zeros(len(q), np.int64))]
        while stack:
            depth, who, node, so_far = stack.pop()
            if len(who) > FRONTIER:
                half = len(who) // 2
                stack += [(depth, who[half:], node[half:], so_far[half:]), (depth, who[:half], node[:half], so_far[:half])]
                continue
            level = self.levels[depth]
            diff = so_far + np.bitwise_count((self.codes[who] ^ level["value"][node]) & level["own"][node])
            # prune: too different, or the whole group is in the query's component already
            live = (diff <= max_diff) & ~((lows[depth][node] == label[who]) & (highs[depth][node] == label[who]))
            who, node, diff = who[live], node[live], diff[live]
            if not len(who):
                continue
            if depth == 0:
                found_a.append(who)
                found_b.append(node)
                continue
            first, count = level["first"][node], level["last"][node] - level["first"][node]
            ends = np.cumsum(count)
            child = np.arange(ends[-1]) - np.repeat(ends - count, count) + np.repeat(first, count)
            stack.append((depth - 1, np.repeat(who, count), child, np.repeat(diff, count)))
        if not found_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_a), np.concatenate(found_b)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest position of each component) after joining ``a[i]`` with ``b[i]``."""
    label = label.copy()
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt


def _stars(batches: Iterator[pa.RecordBatch], max_diff: int) -> Iterator[pa.RecordBatch]:
    """Spanning stars of the components of a task's buckets; a bucket is never split over tasks."""
    got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not got:
        return
    key, code = (np.concatenate(x) for x in zip(*got))
    code = code.view(np.uint64)
    _, bucket, size = np.unique(key, return_inverse=True, return_counts=True)
    more = size[bucket] > 1
    bucket, code = bucket[more], code[more]
    if not len(code):
        return
    index = GrayIndex(bucket, code)
    label = index.components(max_diff)
    out = np.flatnonzero(label != np.arange(len(label)))
    a, b = index.codes.view(np.int64)[out], index.codes.view(np.int64)[label[out]]
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
    for at in range(0, len(pairs), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 10_000, 0]), pa.array(pairs[at : at + 10_000, 1])], names=["u", "v"])
    del got, key, code, bucket, size, more, index, label, out, a, b, pairs
    release()


def _keys(fp, max_diff: int):
    """One key per pair of blocks: their bits and, in the top byte, the pair's number."""
    n = max_diff + 2
    edges = [64 * i // n for i in range(n + 1)]
    keys = []
    for i, (p, q) in enumerate(combinations(range(n), 2)):
        mask = sum(((1 << (edges[x + 1] - edges[x])) - 1) << edges[x] for x in (p, q))
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(mask).cast("long"))))
    return keys


def links(distinct_fps: DataFrame, max_diff: int = 2) -> DataFrame:
    """Edges (u > v) of a spanning forest of the link graph over distinct ``_fp`` values.

    A key's value is a hash: keys that collide only put more codes in a bucket.
    """
    dealt = distinct_fps.select(F.explode(F.array(*_keys(F.col("_fp"), max_diff))).alias("_key"), "_fp").repartition("_key")
    return dealt.mapInArrow(lambda it: _stars(it, max_diff), "u long, v long")


def _placed(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_diff: int, confirm: tuple[int, int] | None, lossless: bool) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (``_h``, ``_rep``, ``_group``): smallest id and component of each different text."""
    fps = kept(fingerprints(docs, id_col, text_col, shingle))
    texts = kept(fps.groupBy("_h").agg(F.min("_fp").alias("_fp"), F.min("_id").alias("_rep")))
    roots = contract(links(texts.select("_fp").distinct(), max_diff))
    placed = kept(texts.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").select("_h", "_rep", F.coalesce("root", "_fp").alias("_group")))
    if confirm:
        words, percent = confirm
        candidates = placed
        several = placed.groupBy("_group").agg(F.count("*").alias("_texts")).where("_texts > 1").select("_group")
        sets = kept(shingle_sets(docs, kept(placed.join(several, "_group", "left_semi")), id_col, text_col, words))
        placed = kept(placed.join(classes(sets, percent), "_h", "left").select("_h", "_rep", F.coalesce("_class", "_h").alias("_group")))
        if lossless:
            more = kept(similar_texts(docs, candidates, id_col, text_col, words, percent))
            name = placed.select("_h", "_group")
            edges = more.join(name.toDF("u", "_u"), "u").join(name.toDF("v", "_v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
            roots = contract(edges).withColumnRenamed("node", "_group")
            placed = kept(placed.join(roots, "_group", "left").select("_h", "_rep", F.coalesce("root", "_group").alias("_group")))
    return fps, placed


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_diff: int = 2, confirm: tuple[int, int] | None = None, lossless: bool = False) -> DataFrame:
    """(``id_col``, ``fingerprint`` 16 hex digits, ``component_id``) of every row.

    Rows link if their fingerprints differ in at most ``max_diff`` bits;
    ``component_id`` is the smallest id reachable.  Equal fingerprints link, so
    exact copies and repeated rows share a component.  Null and blank texts have
    fingerprint 0 and link as any other.  Null ids never are the smallest; a
    component of null ids only has a null ``component_id``.  An empty table
    gives an empty result; other columns are not read.

    With ``confirm`` = (words, percent) components are divided by an exact check:
    two of their texts link if the Jaccard similarity of their shingles of so many words
    is at least ``percent`` / 100.  Equal texts always link.  With ``lossless`` too, all other pairs
    of that similarity link as well, however far apart their fingerprints are.
    """
    refuse((id_col,), ["fingerprint", "component_id"])
    fps, placed = _placed(docs, id_col, text_col, shingle, max_diff, confirm, lossless)
    least = placed.groupBy("_group").agg(F.min("_rep").alias("component_id"))
    named = placed.join(least, "_group").select("_h", "component_id")
    return fps.join(named, "_h").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_diff: int = 2, confirm: tuple[int, int] | None = None, lossless: bool = False) -> DataFrame:
    """The rows of ``docs`` but for near copies of a row with a smaller id; all columns stay.

    Parameters are those of ``near_duplicates``.  One row of each component stays, that of the
    smallest id, or of the smallest MD5 where texts share it (or have null ids only); of rows
    repeated with the same id and text one.
    """
    fps, placed = _placed(docs, id_col, text_col, shingle, max_diff, confirm, lossless)
    first = F.min(F.struct(F.col("_rep").isNull().alias("_none"), "_rep", "_h")).alias("_first")
    least = placed.groupBy("_group").agg(first).select("_first._h", "_first._rep")
    copies = fps.groupBy("_h", "_id").agg(F.count("*").alias("_n")).withColumnRenamed("_h", "_own")
    keep = kept(least.join(copies, (F.col("_h") == F.col("_own")) & F.col("_rep").eqNullSafe(F.col("_id"))).select("_h", "_rep", "_n"))
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_t"))
    packed = with_bytes(source, "_t", "_row", "_id").select("_row", "_id", F.md5("_b").alias("_own"))
    rows = packed.join(keep, (F.col("_own") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_rep")))
    once = rows.where("_n = 1").select("_row")
    again = rows.where("_n > 1").groupBy("_h").agg(F.first("_row").alias("_row")).select("_row")
    return once.unionByName(again).select("_row.*")
