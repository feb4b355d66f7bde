"""Chunks of texts that are larger than a cell: texts come in pieces, and no task holds more than one of them at a time.

Where a chunk begins depends on all chunks before it.  But within a piece every place where one may begin has one next
place, so each piece is a function from the place where the first chunk in it begins to the place where the first one
behind it does; it is found for all places at once, by doubling steps.  It has an entry for each of the ``size`` first places, as
no chunk reaches further.  The functions of a text's pieces are then followed in order, one look-up each, and every piece cuts its own chunks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.splits import _splits, lines
from .chunking import Breaks

#: Characters of a piece.
PIECE = 1 << 20
#: A place behind the end of the text.
OVER = 1 << 40


def next_starts(text: str, n: int, size: int, overlap: int, ends: bool) -> np.ndarray:
    """Where the next chunk begins, for a chunk that begins at each of the first ``n`` places; ``ends``: the text ends with ``text``.

    The rule is that of ``chunking.spans``.
    """
    at = np.arange(n)
    to = np.full(n, -1, np.int64)
    for places, length in Breaks(text).kinds:
        places = np.asarray(places, np.int64)
        if len(places):
            i = np.searchsorted(places, at + size - length, side="right") - 1
            last = np.where(i >= 0, places[np.maximum(i, 0)], -1)
            to = np.where((to < 0) & (last >= at), last, to)
    to = np.where(to <= at + overlap, at + size, to)
    out = to - overlap
    return np.where(at + size >= len(text), OVER, out) if ends else out


def crossing(text: str, ahead: str, size: int, overlap: int) -> np.ndarray:
    """For each place in a piece where its first chunk may begin, where the first chunk behind the piece does, counted from its end."""
    n = len(text)
    jump = next_starts(text + ahead, n, size, overlap, len(ahead) < size)
    first = np.arange(min(n, size))
    while True:
        out = jump[first]
        if (out >= n).all():
            return np.where(out >= OVER, OVER, out - n)
        inside = jump < n
        jump = np.where(inside, jump[np.minimum(jump, n - 1)], jump)


def pieces(docs: DataFrame, id_col: str = "doc_ord", text_col: str = "text", length: int = PIECE) -> DataFrame:
    """(``id_col``, piece, text) of texts in cells; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                parts = [text[k : k + length] for k in range(0, len(text or ""), length)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(parts), pa.int64())), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], names=[id_col, "piece", "text"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece bigint, text string")


def file_pieces(spark: SparkSession, paths: list[str], length: int = PIECE) -> DataFrame:
    """(path, piece, text) of text files of any size.  Files are read twice by splits, and their text is shuffled once.

    Bytes that are no UTF-8 are replaced.  The table of where splits begin, a row each, is sent to all tasks.
    """
    read = lines(spark, paths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, block), own in _splits(batches):
            chars = sum(len(line) + 1 for line in own)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([chars], pa.int64())], names=["path", "block", "chars"])

    counted = read.mapInArrow(count, "path string, block bigint, chars bigint")
    w = Window.partitionBy("path").orderBy("block")
    starts = counted.select("path", "block", (F.sum("chars").over(w) - F.col("chars")).alias("start"), F.lead("block").over(w).isNull().alias("last"))
    # a last line without a line feed: the file is one byte shorter than its lines with theirs
    ends = read.groupBy("path").agg(F.sum(F.length("line") + 1).alias("n")).join(sizes(spark, paths), "path").select("path", (F.col("n") > F.col("size")).alias("bare"))
    starts = starts.join(ends, "path").select("path", "block", "start", (F.col("last") & F.col("bare")).alias("bare"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, _, start, bare), own in _splits(batches):
            held: list[str] = []
            size, at = 0, start

            def out(text: str, at: int) -> pa.RecordBatch:
                rows = []
                while text:
                    room = length - at % length
                    rows.append((path, at // length, at, text[:room]))
                    text, at = text[room:], at + len(text[:room])
                return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["path", "piece", "at", "text"])

            for line in own:
                held += [line, "\n"]
                size += len(line) + 1
                if size >= length:
                    # the last character waits, as it may be a line feed that the file does not have
                    text = "".join(held)
                    yield out(text[:-1], at)
                    at, held, size = at + len(text) - 1, [text[-1]], 1
            text = "".join(held)
            yield out(text[:-1] if bare else text, at)

    parts = read.join(F.broadcast(starts), ["path", "block"]).select("path", "block", "start", "bare", "line").mapInArrow(cut, "path string, piece bigint, at bigint, text string")
    return parts.groupBy("path", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p")).select("path", "piece", F.array_join("p.text", "").alias("text"))


def sizes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, size) of files in bytes; their contents are not read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"))


def chunk_pieces(pieces: DataFrame, size: int = 6000, overlap: int = 500, id_col: str = "doc_ord") -> DataFrame:
    """(``id_col``, chunk_idx, text): the chunks of texts in pieces (``id_col``, piece from 0, text), those of ``chunking.chunks``.

    All pieces of a text but its last must have one length of ``size`` characters or more.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    own = pieces.select(F.col(id_col).alias("_id"), F.col("piece").cast("long").alias("piece"), "text")
    heads = own.where("piece > 0").select("_id", (F.col("piece") - 1).alias("piece"), F.substring("text", 1, size).alias("ahead"))
    rows = own.join(heads, ["_id", "piece"], "left").select("_id", "piece", "text", F.coalesce("ahead", F.lit("")).alias("ahead"))
    kind = own.schema["_id"].dataType.simpleString()

    def map_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, ahead) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                if ahead and len(text) < size:
                    raise ValueError(f"a piece of {len(text)} characters is not the last of its text; chunks have {size}")
                where = crossing(text, ahead, size, overlap)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([len(text)], pa.int64()), pa.array([where.astype("<i8").tobytes()], pa.binary())], names=["_id", "piece", "n", "out"])

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a text come in order, and texts one after the other."""
        text = at = None
        for b in batches:
            begins = []
            for doc, piece, n, out in zip(*(c.to_pylist() for c in b.columns)):
                if piece == 0 or doc != text:
                    text, at = doc, 0
                begins.append(at if at < n else None)
                at = int(np.frombuffer(out, "<i8")[at]) if at < n else at - n if at < OVER else at
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(begins, pa.int64())], names=["_id", "piece", "begin"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, ahead, at) in enumerate(zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))):
                whole, breaks, found = text + ahead, Breaks(text + ahead), []
                while at < len(text):
                    last = len(ahead) < size and at + size >= len(whole)
                    to = len(whole) if last else breaks.last(at, at + size)
                    if not last and to <= at + overlap:
                        to = at + size
                    if chunk := whole[at:to].strip():
                        found.append(chunk)
                    if last:
                        break
                    at = to - overlap
                k = len(found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * k, pa.int64())), b.column(1).take(pa.array([i] * k, pa.int64())), pa.array(range(k), pa.int64()), pa.array(found, pa.string())], names=["_id", "piece", "k", "text"])

    out = rows.mapInArrow(map_out, f"_id {kind}, piece bigint, n bigint, out binary")
    begins = out.repartition("_id").sortWithinPartitions("_id", "piece").mapInArrow(follow, f"_id {kind}, piece bigint, begin bigint")
    found = rows.join(begins.where("begin IS NOT NULL"), ["_id", "piece"]).mapInArrow(cut, f"_id {kind}, piece bigint, k bigint, text string")
    # pieces number their chunks, and texts their pieces
    before = found.groupBy("_id", "piece").agg(F.count("*").alias("n")).select("_id", "piece", F.coalesce(F.sum("n").over(Window.partitionBy("_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return found.join(before, ["_id", "piece"]).select(F.col("_id").alias(id_col), (F.col("first") + F.col("k")).cast("int").alias("chunk_idx"), "text")
