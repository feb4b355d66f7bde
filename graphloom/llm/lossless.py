"""Lossless join of texts by the Jaccard similarity of word shingles, by prefix filter.

Two sets of similarity t or more share one of the first n - ceil(t * n) + 1 elements at
least, if both are sorted by one order.  Any order will do.  Here elements of many texts come last: every
text gives a fifth of its elements, drawn by its own hash, to a count over all texts, and
those counted often enough go to all tasks, the commonest first if they are more than a bound.  So common lines seldom
are among the first elements, and the number of texts that share one does not grow with the corpus.  Pairs that
lie in one candidate group already are left out: the exact check of the group has
decided them.  Of the others, those stay whose sizes and number of shared first elements
allow the similarity, and these are compared in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import kept
from .confirm import shingle_set, shingle_sets
from .windows import mix
from .words import only, release, slices, with_bytes

#: Of a text's shingles one in so many is counted; counts from which on a shingle is frequent; most frequent shingles sent to tasks (16 bytes each).
DRAWN, FREQUENT, MOST = 5, 4, 1 << 20

def prefix(items: np.ndarray, percent: int, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first elements of a sorted set; ``often`` (sorted) are the frequent ones, ``times`` how frequent."""
    first = len(items) + (-percent * len(items)) // 100 + 1
    if len(often):
        at = np.minimum(np.searchsorted(often, items), len(often) - 1)
        items = items[np.argsort(np.where(often[at] == items, times[at], 0), kind="stable")]
    return items[:first]


def drawn(items: np.ndarray, name: str) -> np.ndarray:
    """One in DRAWN of a text's elements, which ones depends on the text."""
    return items[mix(items.view(np.uint64) ^ np.uint64(int(name[:16], 16))) % np.uint64(DRAWN) == 0]


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, pick: Callable[[], Callable]) -> DataFrame:
    """(``_id``, ``_h``, ``_n``, ``_p``): id, MD5, number of shingles, and those that ``pick()(shingles, MD5)`` chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = pick()
        for b in slices(batches):
            sets = [shingle_set(t, size) for t in b.column(2).to_pylist()]
            some = [choose(s, h) for s, h in zip(sets, b.column(1).to_pylist())]
            ends = np.cumsum([0, *map(len, some)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(some)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(len, sets)), pa.int64()), lists], names=["_id", "_h", "_n", "_p"])

    rows = with_bytes(only(docs, _id=id_col, _t=text_col), "_t", "_id").select("_id", F.md5("_b").alias("_h"), "_b")
    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _h string, _n long, _p array<long>")


def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb) for every two texts of different groups in a bucket whose sizes allow the similarity."""
    got = [[np.asarray(c) for c in b.columns] for b in batches]
    if not got:
        return
    key, group, text, n = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((text, n, key))
    key, group, text, n = key[order], group[order], text[order], n[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])]
    key, group, text, n = key[new], group[new], text[new], n[new]
    at, far = np.arange(len(key)), 1
    while len(at):
        at = at[at + far < len(key)]
        # sizes ascend within a bucket, so a row that is through with its bucket stays so
        at = at[(key[at] == key[at + far]) & (100 * n[at] >= percent * n[at + far])]
        i = at[group[at] != group[at + far]]
        j = i + far
        flip = text[i] > text[j]
        i, j = np.where(flip, j, i), np.where(flip, i, j)
        for k in range(0, len(i), 10_000):
            p, q = i[k : k + 10_000], j[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (text[p], text[q], n[p], n[q])], names=["a", "b", "na", "nb"])
        far += 1
    del got, key, group, text, n, order, new, at
    release()


def similar_texts(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str, size: int = 5, percent: int = 80) -> DataFrame:
    """(u, v): the MD5s of every two texts of different groups of similarity ``percent`` / 100 and more.

    ``placed``: (``_h``, ``_rep``, ``_group`` long), a row per different text; ``_rep`` is the id of a row that has it.
    """
    some = _sets(docs, id_col, text_col, size, lambda: drawn).select(F.explode("_p").alias("_s"))
    counts = kept(some.groupBy("_s").agg(F.count("*").alias("_c")).where(F.col("_c") >= FREQUENT)).orderBy(F.desc("_c"), "_s").limit(MOST).toArrow()
    often, times = (counts.column(c).to_numpy().astype(np.int64) for c in ("_s", "_c"))
    order = np.argsort(often)
    sent = docs.sparkSession.sparkContext.broadcast((often[order], times[order]))
    firsts = _sets(docs, id_col, text_col, size, lambda: lambda items, _: prefix(items, percent, *sent.value))
    listed = placed.select(F.col("_h").alias("_want"), "_rep", "_group")
    # no sort of the lists: the hash table holds the short rows
    mine = firsts.join(listed.hint("shuffle_hash"), (F.col("_h") == F.col("_want")) & F.col("_id").eqNullSafe(F.col("_rep")))
    dealt = mine.select(F.explode("_p").alias("_key"), "_group", F.xxhash64("_h").alias("_text"), "_n").repartition("_key")
    found = dealt.mapInArrow(lambda it: _pairs(it, percent), "a long, b long, na long, nb long")
    # beyond the first elements of the one that ends earlier, all its others may be shared
    rest = F.greatest(*(F.floor((F.col(c) * percent + 99) / 100) - 1 for c in ("na", "nb")))
    enough = found.groupBy("a", "b").agg(F.count("*").alias("_c"), F.min("na").alias("na"), F.min("nb").alias("nb")).where((F.col("_c") + rest) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    pairs = kept(enough.select("a", "b"))
    wanted = pairs.select(F.col("a").alias("_text")).unionByName(pairs.select(F.col("b").alias("_text"))).distinct()
    texts = placed.select(F.xxhash64("_h").alias("_text"), "_h", "_rep").join(wanted, "_text").select(F.col("_text").alias("_group"), "_h", "_rep")
    sets = kept(shingle_sets(docs, kept(texts), id_col, text_col, size))
    one, two = (sets.select(F.col("_group").alias(t), F.col("_h").alias(h), F.col("_n").alias(f"_n{t}"), F.col("_s").alias(f"_s{t}")) for t, h in (("a", "u"), ("b", "v")))
    alike = F.size(F.array_intersect("_sa", "_sb")) * (100 + percent) >= (F.col("_na") + F.col("_nb")) * percent
    return pairs.join(one, "a").join(two, "b").where(alike).select("u", "v").distinct()
