"""Shortest-pack-first histogram packing of token sequences.

Documents are cut into pieces of at most ``size`` tokens.  Only the histogram of
piece lengths (``size`` numbers) is planned on the driver: lengths are placed
longest first, always into the packs that are shortest so far, and packs of equal
content are one pattern with a count, so the plan's size depends on ``size`` and
not on the data.  Each piece then finds its place from its rank among the pieces
of its length: rank within its partition, plus the counts of the partitions before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, texts_of
from .components import kept
from .words import only, refuse, slices


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Packing patterns as (number of packs, lengths in order)."""
    groups: dict[int, list[tuple[int, list[int]]]] = {}
    heap: list[int] = []

    def put(fill: int, count: int, lengths: list[int]) -> None:
        if fill not in groups or not groups[fill]:
            heappush(heap, fill)
        groups.setdefault(fill, []).append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not groups[heap[0]]:
                heappop(heap)
            if not heap or heap[0] + length > size:
                put(length, left, [length])
                break
            fill = heap[0]
            count, lengths = groups[fill].pop()
            some = min(left, count)
            if count > some:
                groups[fill].append((count - some, lengths))
            put(fill + length, some, [*lengths, length])
            left -= some
    return [p for fill in sorted(groups) for p in groups[fill]]


class Places:
    """Where the piece of a given length and rank goes."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        by: dict[int, list[tuple[int, int, int]]] = {}
        base = 0
        for count, lengths in patterns:
            at = 0
            for n in lengths:
                by.setdefault(n, []).append((count, base, at))
                at += n
            base += count
        self.sequences = base
        self.by = {n: tuple(map(np.array, zip(*slots))) for n, slots in by.items()}
        self.ends = {n: np.cumsum(x[0]) for n, x in self.by.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            n = int(length[at[0]])
            count, base, off = self.by[n]
            slot = np.searchsorted(self.ends[n], rank[at], side="right")
            sequence[at] = base[slot] + rank[at] - (self.ends[n][slot] - count[slot])
            offset[at] = off[slot]
        return sequence, offset


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, size: int, end_id: int) -> DataFrame:
    """One row per piece, with its partition and its rank among that partition's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, seen = codec(path), TaskContext.get().partitionId(), [0] * (size + 1)
        mark = end_id.to_bytes(4, "little")
        for b in slices(batches):
            row, start, length, crc, total, rank = [], [], [], [], [], []
            for i, ids in enumerate(c.encode(b.column(1).to_pylist())):
                ids += mark
                n = len(ids) // 4
                for at in range(0, n, size):
                    some = min(size, n - at)
                    row.append(i)
                    start.append(at)
                    length.append(some)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + some)]))
                    total.append(n)
                    rank.append(seen[some])
                    seen[some] += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())], names=["_id", "start", "length", "ids_crc32", "doc_tokens", "_part", "_rank"])

    source = texts_of(only(docs, _id=id_col, _t=text_col), "_t", "_id")
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, _part int, _rank long")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id``, so null and empty texts are one
    token.  Pieces are full but for the document's last.  Repeated rows are
    packed as often as they come; ids may be null; other columns are not read.
    """
    refuse((id_col,), ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    cut = kept(pieces(docs, path, id_col, text_col, size, end_id))
    counts = kept(cut.groupBy("_part", "length").agg(F.count("*").alias("_n")))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    # at most ``size`` rows
    histogram = {r["length"]: r["_n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    places = Places(plan(histogram, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sequence, offset = places.find(np.asarray(b.column("length")), np.asarray(b.column("_rank")))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = cut.join(offsets, ["_part", "length"]).select("_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_rank") + F.col("_before")).alias("_rank"))
    kind = cut.schema["_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
