"""The queries opN_* and their SQL; each is a thin layer over its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary() -> str:
    """The public tokenizer file that the queries use; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_diff=2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import derivatives

    made = derivatives(table(spark, sf_dir, "pages"))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "source_digest", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES).withColumn("worse", F.round("worse", 6))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    training = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    return score(table(spark, sf_dir, "documents"), training)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(), size=1024, end_id=0)


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiff import stored_digests

    return stored_digests(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import digests

    return digests(table(spark, sf_dir, "documents"), size=50)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .private import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"), group=20, heads=4)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import run_digests

    return run_digests(table(spark, sf_dir, "documents"), min_length=6, exponent=4, planted=True)


# ------------------------------------------------------------ what SQL can say of the others
def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def warc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = op3_warc(spark, sf_dir)
    pair = made.groupBy("page_id").agg(F.countDistinct("refers_to").alias("_n"))
    return made.join(pair, "page_id").select("page_id", "warc_type", "target_uri", "content_type", (F.col("refers_to").startswith("<urn:uuid:") & (F.col("_n") == 1)).alias("refers_to_response"))


def tiff_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_tiff(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


Queries = dict[str, Callable[[SparkSession, str], DataFrame]]


def queries() -> Queries:
    return {f.__name__: f for f in (op1_simhash, op2_quality, op3_warc, op4_html, op5_urls, op6_lm, op7_bpe, op8_packing, op9_tiff, op10_substring, op11_personal_data, op12_prefix_trie, op13_runs)}


def parts() -> Queries:
    """Those columns of queries without SQL that SQL can express."""
    return {f.__name__: f for f in (lm_base, warc_links, tiff_payloads)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {"op2_quality": oracles.quality(), "op5_urls": oracles.urls(RULES), "op10_substring": oracles.substring(50), "op11_personal_data": oracles.personal(), "op12_prefix_trie": oracles.trie(), "op13_runs": oracles.runs(), "lm_base": oracles.lm_base(), "warc_links": oracles.warc_links(), "tiff_payloads": oracles.tiff_payloads()}
