"""Cleaning pipeline over ``documents``: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet to the folder that all executors share and rereads it for the next stage.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.packing import pack
from graphloom.llm.quality import keep_good
from graphloom.llm.queries import vocabulary
from graphloom.llm.simhash import keep_one
from graphloom.llm.substring import dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies have a Jaccard similarity of 0.8 or more over five-word shingles, decided by an exact check.
    Fingerprints of word pairs up to 6 bits apart, chained, give the groups that the check divides: most near copies, and
    large groups of them, lie in one.  All pairs further apart are found by a lossless join on the
    shingles themselves, so the distance decides the cost only and not the result.
    """
    return keep_one(docs, shingle=2, max_diff=6, confirm=(5, 80), lossless=True)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that one with a smaller id has."""
    return dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 1024."""
    return pack(docs, vocabulary())


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_duplicates), ("substring dedup", repeated_passages), ("packing", packing)]
#: Suffix arrays, fingerprint components and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    base = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
