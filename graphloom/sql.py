"""The engine's functions in SQL, once ``register`` has named them to a session.

    SELECT * FROM chunks(TABLE(docs), 6000, 500)
    SELECT normalize_label(label), fuzzy_ratio(a, b), repair_json(raw).json FROM answers

Frames use the same functions without it; ``chunks`` here goes row by row, ``functions.chunking.chunks`` by batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .functions.chunking import split_chars
from .functions.jsonrepair import repair_json
from .functions.text import fuzzy_ratio, normalize_text


class Chunks:
    """A row for each chunk of the table's column ``text``: its other columns, ``chunk_idx`` and ``text``; null and blank texts have none."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, size: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        if not docs.isTable or "text" not in docs.dataType.names:
            raise ValueError("chunks needs a table with a column text")
        given = [6000 if size is None else size.value, 500 if overlap is None else overlap.value]
        if any(x is None for x in given) or not 0 <= given[1] < given[0]:
            raise ValueError("size and overlap must be constants, and overlap at least 0 and less than size")
        kept = [f for f in docs.dataType.fields if f.name not in ("text", "chunk_idx")]
        return AnalyzeResult(T.StructType([*kept, T.StructField("chunk_idx", T.IntegerType()), T.StructField("text", T.StringType())]))

    def eval(self, docs: Row, size: int = 6000, overlap: int = 500) -> Iterator[tuple]:
        kept = [v for k, v in docs.asDict().items() if k not in ("text", "chunk_idx")]
        for i, chunk in enumerate(split_chars(docs["text"] or "", size, overlap)):
            yield (*kept, i, chunk)


@F.pandas_udf(T.StringType())
def _normalize(labels: pd.Series) -> pd.Series:
    return labels.map(normalize_text)


def register(spark: SparkSession) -> None:
    """Names chunks, normalize_label, fuzzy_ratio and repair_json to the session."""
    spark.udtf.register("chunks", F.udtf(Chunks))
    spark.udf.register("normalize_label", _normalize)
    spark.udf.register("fuzzy_ratio", fuzzy_ratio)
    spark.udf.register("repair_json", repair_json)
