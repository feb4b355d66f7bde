"""Answers that outlive their run, so that the next one asks only for those that are missing.

A chunk's answer is known by its document's name, its place and text in it; a reply about an edge by what was asked of
it.  Either counts only for the settings on which it depends: provider, model, prompt and the rest.
They stand in Parquet, in batches: each batch that was answered is there for good, whatever becomes of the run.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.materialize import materialize
from .sources.providers import GOOD, PROMPT, responses

ANSWERS = "key string, config_hash string, raw string, status string, error string, json string"
#: Requests of a batch, and batches of a run at most; with more chunks batches are larger.
BATCH, BATCHES = 512, 64


def keyed(chunks: DataFrame) -> DataFrame:
    """Chunks (name, doc_ord, chunk_idx, text) with ``key``; it does not depend on what other documents there are."""
    return chunks.withColumn("key", F.sha2(F.concat_ws("\x1f", "name", F.col("chunk_idx").cast("string"), "text"), 256))


def stored(spark: SparkSession, folder: str, schema: str = ANSWERS, tell: bool = False) -> DataFrame:
    """All rows under ``folder``; none if there is no such folder yet, or if it holds no answers.

    Files that cannot be read are passed over, as what stood in them is asked for again; ``tell`` warns how many there are.
    """
    try:
        found = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "false").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    if tell and (broken := len(found.inputFiles()) - found.select("_metadata.file_path").distinct().count()):
        warnings.warn(f"{broken} files of answers under {folder} cannot be read; their answers are asked for again", stacklevel=2)
    return found


def add(todo: DataFrame, by: list[str], make: Callable[[DataFrame], DataFrame], folder: str) -> None:
    """Writes what ``make`` makes of ``todo`` to ``folder``, batch by batch; rows with the same ``by`` are in one batch."""
    batches = min(BATCHES, -(-todo.count() // BATCH))
    for i in range(batches):
        some = todo.where(F.pmod(F.xxhash64(*by), F.lit(batches)) == i)
        if not some.isEmpty():  # a file without rows would count as one that cannot be read
            make(some).write.mode("append").parquet(folder)


def best(rows: DataFrame, of: list[str]) -> DataFrame:
    """(key, ``of``) with one row for each key: an answer given twice counts once, a good one before others."""
    first = F.struct(~F.col("status").isin(*GOOD), *[F.coalesce(c, F.lit("")) for c in of])
    return rows.groupBy("key").agg(F.min_by(F.struct(*of), first).alias("_a")).select("key", "_a.*")


def good(rows: DataFrame) -> Column:
    return rows["status"].isin(*GOOD)


def answered(chunks: DataFrame, provider: Callable[[str], str], folder: str, config_hash: str, resume: bool = True, workers: int | None = None, prompt: str = PROMPT) -> DataFrame:
    """(doc_ord, chunk_idx, raw, status, error, json) of all chunks (name, doc_ord, chunk_idx, text).

    With ``resume`` good answers under ``folder`` of the same settings are taken as they are.  Others are asked for, batch by
    batch, and added.  Failed answers are added too, with their error, and are asked for again the next time.
    """
    spark = chunks.sparkSession
    chunks = materialize(keyed(chunks))
    before = stored(spark, folder, tell=True).where(F.col("config_hash") == config_hash)
    left = chunks.select("key", "chunk_idx", "text").dropDuplicates(["key"])
    if resume:
        left = left.join(before.where(good(before)).select("key"), "key", "left_anti")
    left = materialize(left)

    def make(some: DataFrame) -> DataFrame:
        # one document number per chunk keeps the key through the requests
        numbers = materialize(some.withColumn("doc_ord", F.monotonically_increasing_id()))
        got = responses(numbers, provider, prompt, workers)
        return got.join(numbers.select("doc_ord", "key"), "doc_ord").select("key", F.lit(config_hash).alias("config_hash"), "raw", "status", "error", "json")

    add(left, ["key"], make, folder)
    now = stored(spark, folder).where(F.col("config_hash") == config_hash)
    return chunks.select("doc_ord", "chunk_idx", "key").join(best(now, ["raw", "status", "error", "json"]), "key").drop("key")
