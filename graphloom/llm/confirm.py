"""Exact check of candidate groups by the Jaccard similarity of word shingles.

A candidate group is divided into the connected components of its texts under
"similarity at or above the limit", without comparing all pairs.  A pivot text is
compared with the others of its group; classes that touch are joined.  A link that is
still missing joins two classes, so one end of it lies outside the group's largest
class: once every text outside has been a pivot the group is finished.  Groups
of true copies take a pivot or two, however large they are, and no link is lost in others.

A group of bounded size is divided within a task, where an index from shingles to
texts compares a pivot with all others at once.  Larger groups are spread
over tasks, with a few pivots a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import contract, kept
from .words import only, slices, with_bytes

#: Rows up to which the list of candidate texts is broadcast (some 60 bytes a row).
BROADCAST_ROWS = 100_000
#: Shingles of all texts of a group up to which one task divides it (8 bytes each).
GROUP_SHINGLES = 4 << 20
#: Most pivots of a group in one round; further ones take further rounds.
PIVOTS = 64


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased (A-Z) word shingles; a shorter text is one shingle."""
    words = text.lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64).view(np.int64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, joined), np.uint64, len(words) - size + 1).view(np.int64))


def shingle_sets(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(``_group``, ``_h``, ``_n``, ``_s``) of the listed texts; each is read from the row ``_rep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, size) for t in b.column(2).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends)), lists], names=["_group", "_h", "_n", "_s"])

    listed = texts.select("_group", F.col("_h").alias("_want"), "_rep")
    if listed.count() <= BROADCAST_ROWS:
        listed = F.broadcast(listed)
    rows = with_bytes(only(docs, _id=id_col, _t=text_col), "_t", "_id").select("_id", "_b", F.md5("_b").alias("_h"))
    found = rows.join(listed, (F.col("_h") == F.col("_want")) & F.col("_id").eqNullSafe(F.col("_rep")))
    return found.select("_group", "_h", "_b").mapInArrow(run, "_group long, _h string, _n long, _s array<long>")


def divide(sets: list[np.ndarray], percent: int = 80) -> np.ndarray:
    """For each set of a group the first one of its class."""
    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(size) - size
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    run = np.cumsum(np.r_[False, flat[order][1:] != flat[order][:-1]])
    number = np.empty(len(flat), np.int64)
    number[order] = run
    owner, ends = owner[order], np.cumsum(np.bincount(run))
    count = np.diff(np.r_[0, ends])
    label, done = np.arange(n), np.zeros(n, bool)
    step = max(1, (1 << 20) // n)
    while True:
        free = np.flatnonzero(~done & (label != np.bincount(label).argmax()))
        if not len(free):
            return label
        pivot = free[0]
        done[pivot] = True
        mine = number[starts[pivot] : starts[pivot] + size[pivot]]
        shared = np.zeros(n, np.int64)
        for at in range(0, len(mine), step):
            part = mine[at : at + step]
            many = count[part]
            upto = np.cumsum(many)
            shared += np.bincount(owner[np.arange(upto[-1]) + np.repeat(ends[part] - upto, many)], minlength=n)
        touched = np.unique(label[shared * (100 + percent) >= (size + size[pivot]) * percent])
        label[np.isin(label, touched)] = touched[0]


def _within(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Divides the groups of a task, which come one after the other."""

    def finished() -> pa.RecordBatch:
        names = list(held)
        label = divide(list(held.values()), percent)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([names[i] for i in label], pa.string())], names=["_h", "_class"])

    now, held = None, {}
    for b in batches:
        values, ends = np.asarray(b.column(2).values), np.asarray(b.column(2).offsets)
        for i, (group, name) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            if group != now and held:
                yield finished()
                held = {}
            now = group
            held[name] = values[ends[i] : ends[i + 1]].copy()
    if held:
        yield finished()


def classes(sets: DataFrame, percent: int = 80, most_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(``_h``, ``_class``) of (``_group``, ``_h``, ``_n``, ``_s``): components of similarity ``percent`` / 100 and more.

    ``_h`` names a text and occurs in one group only; repeated rows do no harm; no column may be null; an empty table gives an empty
    result.
    Groups of more than ``most_shingles`` are spread over tasks.
    """
    size = kept(sets.groupBy("_group").agg(F.sum("_n").alias("_sum")))
    large = size.where(F.col("_sum") > most_shingles).select("_group")
    if large.isEmpty():
        small, rest = sets, None
    else:
        small, rest = sets.join(large, "_group", "left_anti"), sets.join(large, "_group", "left_semi")
    dealt = small.select("_group", "_h", "_s").repartition("_group").sortWithinPartitions("_group")
    found = dealt.mapInArrow(lambda it: _within(it, percent), "_h string, _class string")
    return found if rest is None else found.unionByName(spread_classes(kept(rest), percent))


def spread_classes(sets: DataFrame, percent: int = 80) -> DataFrame:
    """As ``classes``, in rounds over tasks."""
    state = kept(sets.select("_group", "_h").distinct().select("_group", "_h", F.col("_h").alias("_class"), F.lit(False).alias("_done")))
    most = 1
    while True:
        sizes = state.groupBy("_group", "_class").agg(F.count("*").alias("_size"))
        largest = sizes.groupBy("_group").agg(F.max(F.struct("_size", "_class")).alias("_top"), F.count("*").alias("_classes")).where("_classes > 1").select("_group", F.col("_top._class").alias("_top"))
        free = state.where(~F.col("_done")).join(largest, "_group").where("_class <> _top")
        slot = F.pmod(F.xxhash64("_h", F.lit(most)), F.lit(most))
        chosen = kept(free.groupBy("_group", slot.alias("_slot")).agg(F.min(F.struct("_h", "_class")).alias("_p")).select(F.col("_p._h").alias("_h"), F.col("_p._class").alias("_pclass")))
        if chosen.isEmpty():
            return state.select("_h", "_class")
        pivots = sets.dropDuplicates(["_h"]).join(chosen, "_h").select("_group", "_pclass", F.col("_n").alias("_pn"), F.col("_s").alias("_ps"))
        alike = (
            (F.col("_class") != F.col("_pclass"))
            & (F.least("_n", "_pn") * 100 >= F.greatest("_n", "_pn") * percent)
            & (F.size(F.array_intersect("_s", "_ps")) * (100 + percent) >= (F.col("_n") + F.col("_pn")) * percent)
        )
        links = sets.join(state.select("_h", "_class"), "_h").join(pivots, "_group").where(alike).select("_class", "_pclass").distinct()
        if most == 1:  # one pivot a group: its links are a star already
            names = links.select(F.col("_class").alias("node"), F.col("_pclass").alias("root"))
        else:
            names = contract(links.select(F.col("_class").alias("u"), F.col("_pclass").alias("v")))
        after = state.join(names.withColumnRenamed("node", "_class"), "_class", "left").select("_group", "_h", F.coalesce("root", "_class").alias("_class"), "_done")
        state = kept(after.join(chosen.select("_h", F.lit(True).alias("_now")), "_h", "left").select("_group", "_h", "_class", (F.col("_done") | F.coalesce("_now", F.lit(False))).alias("_done")))
        most = min(most * 4, PIVOTS)
