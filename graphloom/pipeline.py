"""Files to graphs, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, get_config
from .functions.chunking import chunks_by
from .operators.materialize import materialize
from .operators.metrics import RunMetrics
from .operators.refine import enrich, verify
from .operators.resolve import first_of_equals, merge, merge_two_levels
from .progress import answered
from .sources.files import not_blank, read_files, read_graphs, texts
from .sources.providers import PROMPT, Chat, graph_rows, provider_name, responses


def process_files(spark: SparkSession, paths: list[str], provider=None, config: Config | None = None, enriched: bool = True, verified: bool = False, resume: bool = True, metrics: RunMetrics | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged (nodes, edges) of documents, resolved within each and then across them.

    Without a provider the configured endpoint is asked, of the configured model or else its first.  With ``config.answers_dir`` answers
    stay there, and with ``resume`` those of earlier runs are used.  ``metrics`` counts what the run does.
    """
    config = config or get_config()
    provider = provider or Chat(config).resolved()
    docs = not_blank(texts(read_files(spark, paths)))
    cut = chunks_by(docs, config)
    settings = config.answers_hash(provider_name(provider), PROMPT)
    if config.answers_dir:
        named = cut.join(docs.select("doc_ord", "name"), "doc_ord")
        answers = answered(named, provider, _under(config, "chunks"), settings, resume, config.workers)
    else:
        answers = responses(cut, provider, workers=config.workers)
    # answers are kept, so a lost task never asks again for those that came
    answers = materialize(answers)
    if metrics:
        answers = metrics.answers(answers)
    nodes, edges = graph_rows(answers.where("json IS NOT NULL").withColumn("graph_ord", F.col("chunk_idx").cast("long")))
    nodes, edges = merge_two_levels(nodes, edges, config.fuzzy_threshold, metrics=metrics)
    # both are read by every stage and every sink
    nodes, edges = materialize(nodes), materialize(edges)
    how = {"metrics": metrics, "settings": config.model_settings(), "folder": _under(config, "edges"), "resume": resume, "workers": config.workers}
    if enriched:
        edges = materialize(enrich(nodes, edges, provider, config.enrich_batch, **how))
    if verified:
        edges = materialize(verify(nodes, edges, provider, config.verify_batch, **how))
    return nodes, edges


def _under(config: Config, name: str) -> str:
    """The folder of one kind of answers; empty if none are to stay."""
    return f"{config.answers_dir.rstrip('/')}/{name}" if config.answers_dir else ""


def process_file(spark: SparkSession, path: str, provider=None, config: Config | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """``process_files`` of one."""
    return process_files(spark, [path], provider, config, **how)


def merge_files(spark: SparkSession, paths: list[str], threshold: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, bad paths) of graph files; files without a graph are reported and left out."""
    graphs, bad = read_graphs(spark, paths)
    nodes, edges = graph_rows(graphs.withColumn("graph_ord", F.col("doc_ord")))
    nodes, edges = merge(nodes, edges, get_config().fuzzy_threshold if threshold is None else threshold)
    # both are read by every sink
    nodes = materialize(nodes)
    return nodes, materialize(first_of_equals(edges)), bad
