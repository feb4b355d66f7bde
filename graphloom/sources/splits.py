"""Tables and JSON lines in files of any size: each task reads its splits, and no file or line group is held whole.

Whether a line break ends a row depends on all quotation marks before it.  So each split is read first as a function from the
state before it (between rows, or within quotes) to the state after it, with the rows that end in it.  These functions are
composed in the order of the splits, a row per split, which gives every split its state and the number of its first row.
The second reading cuts rows; a row that lies over splits comes in pieces, which are put together by its number.
"""

from __future__ import annotations

import csv
import json
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.materialize import materialize

csv.field_size_limit(sys.maxsize)  # fields may be as long as their row

ROW = "path string, row_ord long, cells array<string>, error string"
#: Lines parsed together.
AT_ONCE = 4096


def open_after(line: str, open_: bool, delimiter: str = ",", ends: re.Pattern | None = None) -> bool:
    """Whether the end of a line lies within quotes, if its beginning does or does not."""
    if '"' not in line:
        return open_
    ends = ends or re.compile(f"[{re.escape(delimiter)}\r]")
    at, n = 0, len(line)
    while True:
        if not open_:  # at the beginning of a field
            if at < n and line[at] == '"':
                at += 1
            else:
                m = ends.search(line, at)
                if m is None or m[0] == "\r":
                    return False
                at = m.end()
                continue
        end = line.find('"', at)
        if end < 0:
            return True
        at = end + 1
        if at < n and line[at] == '"':  # a quotation mark in the field
            at, open_ = at + 1, True
            continue
        open_ = False
        m = ends.search(line, at)
        if m is None or m[0] == "\r":
            return False
        at = m.end()


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, block, line) of files: their lines as bytes, in order within each split, with the split's first byte."""
    return spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(key, lines) of each split in a task; the key is its path, block and further columns, which all its rows share."""
    rows = ((key, line) for b in batches for *key, line in zip(*(c.to_pylist() for c in b.columns)))
    row = next(rows, None)
    while row:
        first = row[0]

        def own() -> Iterator[str]:
            nonlocal row
            while row and row[0] == first:
                yield row[1].decode("utf-8", "replace")
                row = next(rows, None)

        yield tuple(first), own()


def split_states(read: DataFrame, delimiter: str = ",") -> DataFrame:
    """(path, block, open, row_ord) of each split: whether it begins within quotes, and the number of the first row that ends in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = re.compile(f"[{re.escape(delimiter)}\r]")
        for (path, block), own in _splits(batches):
            state, rows = [False, True], [0, 0]
            for line in own:
                for i in (0, 1):
                    state[i] = open_after(line, state[i], delimiter, ends)
                    rows[i] += not state[i]
            yield pa.RecordBatch.from_pylist([{"path": path, "block": block, "after0": state[0], "after1": state[1], "rows0": rows[0], "rows1": rows[1]}], pa.schema([("path", pa.string()), ("block", pa.int64()), ("after0", pa.bool_()), ("after1", pa.bool_()), ("rows0", pa.int64()), ("rows1", pa.int64())]))

    table = materialize(read.mapInArrow(run, "path string, block long, after0 boolean, after1 boolean, rows0 long, rows1 long"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the last split with one state after it whatever was before, and how often the state turned since
    turns = F.col("after0") & ~F.col("after1")
    table = table.withColumn("_turned", F.coalesce(F.count_if(turns).over(before), F.lit(0)) + turns.cast("int"))
    settled = F.col("after0") == F.col("after1")
    last = F.last(F.when(settled, F.struct("after0", "_turned")), ignorenulls=True).over(before)
    table = table.withColumn("_last", last).withColumn("_before", F.coalesce(F.lag("_turned").over(Window.partitionBy("path").orderBy("block")), F.lit(0)))
    odd = (F.col("_before") - F.coalesce("_last._turned", F.lit(0))) % 2 == 1
    table = table.withColumn("open", F.coalesce("_last.after0", F.lit(False)) != odd)
    rows = F.when(F.col("open"), F.col("rows1")).otherwise(F.col("rows0"))
    return table.select("path", "block", "open", F.coalesce(F.sum(rows).over(before), F.lit(0)).alias("row_ord"))


def _cells(text: list[str], delimiter: str) -> list[tuple[list[str] | None, str | None]]:
    """(cells, error) of each row that is given by its text."""
    try:
        got = list(csv.reader(_physical(text), delimiter=delimiter))
        if len(got) == len(text):
            return [(c, None) for c in got]
    except csv.Error:
        pass
    out: list[tuple[list[str] | None, str | None]] = []
    for row in text:
        try:
            out.append((next(csv.reader(_physical([row]), delimiter=delimiter), []), None))
        except csv.Error as e:
            out.append((None, f"Error: {e}"))
    return out


def _physical(rows: list[str]) -> Iterator[str]:
    """The lines of rows, each with its line feed."""
    for row in rows:
        for line in row.split("\n"):
            yield line + "\n"


def read_table(spark: SparkSession, paths: list[str], delimiter: str = ",") -> DataFrame:
    """(path, row_ord, cells, error): rows of delimited files with quoted fields, numbered from 0 in each file.

    Rows are those of a sequential reader, ragged and empty ones too.  A row that cannot be read has an error and no cells.  An
    open quote at the end of a file ends with it.  Bytes that are no UTF-8 are replaced.  Splits are as large as the session says
    (``spark.sql.files.maxPartitionBytes``); the table of their states, a row of some 100 bytes each, is sent to all tasks.
    """
    read = lines(spark, paths)
    states = split_states(read, delimiter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = re.compile(f"[{re.escape(delimiter)}\r]")
        for (path, block, open_, number), own in _splits(batches):
            state, held, whole, begun = open_, [], [], open_

            def rows(number: int) -> pa.RecordBatch:
                got = _cells(whole, delimiter)
                return _batch([(path, number + i, block, c, e, None) for i, (c, e) in enumerate(got)])

            for line in own:
                state = open_after(line, state, delimiter, ends)
                held.append(line)
                if state:
                    continue
                text, held = "\n".join(held), []
                if begun:  # the end of a row that began before
                    yield _batch([(path, number, block, None, None, text)])
                    number, begun = number + 1, False
                    continue
                whole.append(text)
                if len(whole) == AT_ONCE:
                    yield rows(number)
                    number += len(whole)
                    whole.clear()
            yield rows(number)
            if held:
                yield _batch([(path, number + len(whole), block, None, None, "\n".join(held))])

    # the sides are joined without a shuffle, which would undo the order of lines
    made = read.join(F.broadcast(states), ["path", "block"]).select("path", "block", "open", "row_ord", "line").mapInArrow(run, "path string, row_ord long, block long, cells array<string>, error string, piece string")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = _cells(b.column(2).to_pylist(), delimiter)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c for c, _ in got], pa.list_(pa.string())), pa.array([e for _, e in got], pa.string())], names=["path", "row_ord", "cells", "error"])

    made = materialize(made)
    over = made.where("piece IS NOT NULL").groupBy("path", "row_ord").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("p"))
    over = over.select("path", "row_ord", F.array_join("p.piece", "\n").alias("text")).mapInArrow(join, ROW)
    return made.where("piece IS NULL").select("path", "row_ord", "cells", "error").unionByName(over)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("path", pa.string()), ("row_ord", pa.int64()), ("block", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string()), ("piece", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * 6, kinds)], schema=pa.schema(kinds))


def pipe_lines(table: DataFrame) -> DataFrame:
    """(path, line_ord, line) of ``read_table``: the lines of a pipe table under one with its number of rows and columns."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rows = table.select("path", (F.when(F.col("row_ord") > 0, F.col("row_ord") + 2).otherwise(1)).alias("line_ord"), line(F.coalesce("cells", F.array().cast("array<string>"))).alias("line"))
    heads = table.groupBy("path").agg(F.count("*").alias("n"), F.max(F.when(F.col("row_ord") == 0, F.size("cells"))).alias("width"))
    title = heads.select("path", F.lit(0).cast("long").alias("line_ord"), F.concat(F.lit("[CSV — "), (F.col("n") - 1).cast("string"), F.lit(" righe, "), F.col("width").cast("string"), F.lit(" colonne]")).alias("line"))
    rule = heads.select("path", F.lit(2).cast("long").alias("line_ord"), line(F.array_repeat(F.lit("---"), F.col("width"))).alias("line"))
    return title.unionByName(rule).unionByName(rows)


def first_json(spark: SparkSession, paths: list[str], most: int = 100, parse: Callable[[str], object] = json.loads) -> DataFrame:
    """(path, pos, json): the first ``most`` lines of each file that are JSON; no split gives more than so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, block), own in _splits(batches):
            out = []
            for line in own:
                if len(out) < most and line.strip():
                    try:
                        out.append(json.dumps(parse(line), ensure_ascii=False))
                    except (ValueError, RecursionError):
                        continue
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), pa.array([block] * len(out), pa.int64()), pa.array(range(len(out)), pa.int64()), pa.array(out, pa.string())], names=["path", "block", "i", "json"])

    found = lines(spark, paths).mapInArrow(run, "path string, block long, i long, json string")
    at = F.row_number().over(Window.partitionBy("path").orderBy("block", "i")) - 1
    return found.withColumn("pos", at).where(F.col("pos") < most).select("path", "pos", "json")
