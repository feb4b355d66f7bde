"""Word and batch helpers shared by the operators of this subpackage.

Words are maximal runs of characters other than the six ASCII white-space
characters (0x20 and 0x09-0x0D).  On UTF-8 bytes that is exactly what
``bytes.split()`` does, so texts travel as binary columns and are never decoded
only to be split.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = b" \t\n\r\x0b\x0c"
#: Bytes of a slice for methods whose arrays take many times as much memory in every worker.
SLICE = 1 << 19


def with_bytes(df: DataFrame, text_col: str, *others: str) -> DataFrame:
    """``others`` plus column ``_b``: the text's UTF-8 bytes, null as empty."""
    return df.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("_b"))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names, so that no other column's name can clash."""
    return df.select(*[F.col(f"`{c}`").alias(new) for new, c in columns.items()])


def refuse(given: tuple[str, ...], outputs: list[str]) -> None:
    """A ValueError if a column that is passed through has the name of an output, as a result has each name once."""
    clash = [c for c in given if c in outputs]
    if clash:
        raise ValueError(f"columns named like outputs: {', '.join(clash)}")


def slices(batches: Iterable[pa.RecordBatch], column: str = "_b", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes`` of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Hands freed memory back, as Python workers live on and would hold the most that any task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


class Numbering(dict):
    """Dense numbers in order of first sight: ``n[key]`` gives the key's number."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def flat_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words of all texts in order, and the number of words of each text."""
    each = [t.split() for t in texts]
    return [w for ws in each for w in ws], np.fromiter(map(len, each), np.int64, len(each))
