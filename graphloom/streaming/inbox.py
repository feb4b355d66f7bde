"""An inbox of files of any kind, chunked and answered as they come; merging stays a batch over all answers.

What a document is waiting for is kept beside the stream's own checkpoint: its chunks, and the answers that came.  A
document is released once all its chunks have a good answer.  Chunks without one are asked for again with every batch
and with every start, and those that have one never.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..functions.chunking import chunks_by
from ..functions.text import suffix
from ..operators.materialize import materialize
from ..progress import answered, good
from ..sources.files import not_blank, texts
from ..sources.providers import PROMPT, provider_name

FILES = "path string, modificationTime timestamp, length long, content binary"
RELEASED = "doc_ord long, name string, chunk_idx int, raw string, status string, error string, json string"
WAITING = "doc_ord long, name string, chunk_idx int, text string, error string, batch long"


def _table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def arrived(files: DataFrame, batch: int, config: Config) -> DataFrame:
    """(doc_ord, name, chunk_idx, text, error) of a batch of files (path, content): documents are numbered by batch, then path.

    A file without text has one row without a chunk, and its error if it could not be read.
    """
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path"))
    order = files.select("path", (F.lit(batch).cast("long") * (1 << 31) + at).alias("doc_ord"))  # paths alone
    docs = materialize(texts(files.join(order, "path").select("doc_ord", "path", suffix(F.col("path")).alias("ext"), "content")))
    cut = chunks_by(not_blank(docs).select("doc_ord", "text"), config).select("doc_ord", "chunk_idx", "text")
    return docs.select("doc_ord", "name", "error").join(cut, "doc_ord", "left").select("doc_ord", "name", "chunk_idx", "text", "error")


def settle(spark: SparkSession, out: str, state: str, provider: Callable[[str], str], config: Config) -> int:
    """Asks for all answers that documents still wait for, and releases those that are whole to ``out``; the documents still waiting.

    Released documents are those in ``out``, so a run that was cut off and starts again releases none twice.
    """
    waiting = _table(spark, f"{state}/chunks", WAITING).join(_table(spark, out, RELEASED).select("doc_ord").distinct(), "doc_ord", "left_anti")
    waiting = materialize(waiting)
    if waiting.isEmpty():
        return 0
    chunks = waiting.where("chunk_idx IS NOT NULL")
    folder = f"{config.answers_dir.rstrip('/')}/chunks" if config.answers_dir else f"{state}/answers"
    answers = materialize(answered(chunks.select("name", "doc_ord", "chunk_idx", "text"), provider, folder, config.answers_hash(provider_name(provider), PROMPT), workers=config.workers))
    open_ = answers.where(~good(answers)).select("doc_ord").distinct()
    none = waiting.where("chunk_idx IS NULL").select("doc_ord", "name", "chunk_idx", F.lit(None).cast("string").alias("raw"), F.lit("no_text").alias("status"), "error", F.lit(None).cast("string").alias("json"))
    whole = chunks.select("doc_ord", "name", "chunk_idx").join(answers, ["doc_ord", "chunk_idx"]).join(open_, "doc_ord", "left_anti").select(none.columns).unionByName(none)
    if not whole.isEmpty():
        whole.sortWithinPartitions("doc_ord", "chunk_idx").write.mode("append").parquet(out)
    return open_.count()


def follow(spark: SparkSession, inbox: str, out: str, checkpoint: str, provider: Callable[[str], str], config: Config = Config(), once: bool = True) -> StreamingQuery:
    """Appends the answers (RELEASED) of whole documents to Parquet under ``out``; each file counts once, also across restarts."""
    state = f"{checkpoint.rstrip('/')}/inbox"
    settle(spark, out, state, provider, config)  # what an earlier run left open

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        # a batch that is run again writes the same rows in the same place
        arrived(batch.select("path", "content"), number, config).write.mode("overwrite").parquet(f"{state}/chunks/batch={number}")
        settle(own, out, state, provider, config)

    files = spark.readStream.schema(FILES).format("binaryFile").load(inbox)
    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
