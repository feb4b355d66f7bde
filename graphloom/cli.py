"""Command line: documents or graph files to a merged graph, a viewer page and exports."""

from __future__ import annotations

import argparse
import sys
import warnings
from dataclasses import replace

from pyspark.sql import SparkSession

from . import __version__
from .config import Config
from .functions.chunking import dry_run, dry_run_total
from .operators.graph import stats
from .operators.materialize import materialize
from .operators.metrics import RunMetrics
from .operators.numbering import numbered
from .pipeline import merge_files, process_files
from .sinks.export import export_all
from .sources.files import read_files, resolve_paths, texts
from .sources.providers import Chat


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    p.add_argument("files", nargs="+")
    p.add_argument("--merge-jsons", action="store_true", help="the files are graphs")
    p.add_argument("--dry-run", action="store_true", help="report chunks and time only")
    p.add_argument("-o", "--output", default="graph", help="base name of what is written")
    p.add_argument("--export", default="", help="formats, comma-separated: json, graphml, neo4j, turtle, cypher, parquet, jsonl")
    p.add_argument("--parts", action="store_true", help="line formats as folders of parts, for large graphs")
    p.add_argument("--answers", help="folder where answers stay for later runs; default: next to the output")
    p.add_argument("--no-resume", action="store_true", help="ask again for chunks that have an answer")
    p.add_argument("--no-enrich", action="store_true")
    p.add_argument("--verify", action="store_true")
    p.add_argument("--workers", type=int)
    p.add_argument("--model")
    p.add_argument("--url")
    p.add_argument("--tokens", type=int)
    p.add_argument("--chunk-size", type=int)
    p.add_argument("--chunk-overlap", type=int)
    p.add_argument("--stats", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def fail(what: object) -> int:
    print(what, file=sys.stderr)
    return 1


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        config = Config.from_env(dotenv=".env", workers=a.workers, model=a.model, base_url=a.url, max_tokens=a.tokens, chunk_size=a.chunk_size, chunk_overlap=a.chunk_overlap, answers_dir=a.answers)
    except ValueError as e:
        return fail(e)
    if not config.answers_dir:
        config = replace(config, answers_dir=f"{a.output}_answers")
    spark = SparkSession.builder.appName("graphloom").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    found, missing = resolve_paths(spark, a.files)
    if a.merge_jsons and missing:
        return fail("no such file: " + ", ".join(missing))
    if not found:
        return fail("no files")
    metrics = RunMetrics()
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        if a.dry_run:
            report = dry_run(texts(read_files(spark, a.files)), config.chunk_size, config.chunk_overlap)
            report.show(1000, truncate=False)
            dry_run_total(report, config.workers).show()
        elif a.merge_jsons:
            nodes, edges, bad = merge_files(spark, a.files, config.fuzzy_threshold)
            for r in bad.toLocalIterator():
                print(f"not a graph: {r['path']}", file=sys.stderr)
        else:
            try:
                provider = Chat(config).resolved()
            except (OSError, RuntimeError, ValueError) as e:
                return fail(f"no model: {e}")
            nodes, edges = process_files(spark, a.files, provider, config, enriched=not a.no_enrich, verified=a.verify, resume=not a.no_resume, metrics=metrics)
    for w in told:
        print(w.message, file=sys.stderr)
    if a.dry_run:
        return 0
    nodes = materialize(nodes)
    edges = numbered(edges, ["graph_ord", "edge_ord"])
    if nodes.isEmpty():
        return fail("the graph is empty")
    if a.stats:
        stats(nodes, edges).show(truncate=False)
        if not a.merge_jsons:
            print(", ".join(f"{k}: {v}" for k, v in metrics.values().items()))
    for k, v in export_all(nodes, edges, a.output, ["html", *filter(None, a.export.split(","))], one_file=not a.parts).items():
        print(f"{k}: {v}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
