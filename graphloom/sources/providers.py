"""What turns a chunk of text into a graph: rules, recorded answers, or a chat endpoint."""

from __future__ import annotations

import copy
import json
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.jsonrepair import as_text, parse
from ..schema import GRAPH

NODE_TYPES = ("person", "organisation", "place", "event", "concept", "work", "product", "date", "quantity", "other")
PROMPT = f"""Read the text and answer with one JSON object {{"nodes": [...], "edges": [...]}}.
A node has id, label, type (one of {", ".join(NODE_TYPES)}), at most five properties, and a description.
An edge has source and target (node ids), type (an upper-case verb with underscores), label (at most five words), properties, and evidence (a quotation from the text)."""


def provider_name(provider: Callable[[str], str]) -> str:
    """What tells a provider's answers from those of another: its ``name``, or else that of its class or function."""
    named = getattr(provider, "name", None)
    if isinstance(named, str) and named:
        return named
    kind = provider if hasattr(provider, "__qualname__") else type(provider)
    return f"{kind.__module__}.{kind.__qualname__}"


class Replay:
    """Recorded answers by the request's text."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def __call__(self, text: str) -> str:
        return self.answers.get(text, "")


class Chat:
    """An OpenAI-compatible endpoint; empty answers and errors are tried again, then give an empty text."""

    def __init__(self, config: Config, sleep: Callable[[float], None] = time.sleep, post: Callable | None = None):
        self.config, self.sleep, self.error = config, sleep, ""
        self.post = post or self._post

    @property
    def name(self) -> str:
        return f"chat {self.config.base_url} {self.config.model}"

    def _post(self, path: str, body: dict | None) -> dict:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.config.api_key}"}
        request = urllib.request.Request(self.config.base_url.rstrip("/") + path, json.dumps(body).encode() if body else None, headers)
        with urllib.request.urlopen(request, timeout=self.config.timeout_s) as answer:
            return json.load(answer)

    def resolved(self) -> Chat:
        """The same with a model: the configured one, or else the endpoint's first.  Asked once, on the driver."""
        if self.config.model:
            return self
        return Chat(replace(self.config, model=self.discover()), self.sleep, None if self.post == self._post else self.post)

    def discover(self) -> str:
        """The endpoint's first model, for a config without one."""
        models = self.post("/models", None).get("data") or []
        if not models:
            raise RuntimeError("the endpoint lists no model")
        return models[0]["id"]

    def __call__(self, text: str) -> str:
        c, self.error = self.config, ""
        for attempt in range(1, c.retries + 1):
            try:
                got = self.post("/chat/completions", {"model": c.model, "messages": [{"role": "user", "content": text}], "max_tokens": c.max_tokens, "temperature": c.temperature})
                answer = (got["choices"][0]["message"].get("content") or "").strip()
                if answer:
                    return answer
                self.error = "empty answer"
            except urllib.error.HTTPError as e:
                self.error = diagnose(e.code)
                if e.code == 429:
                    self.sleep(min(120, 5 * 2**attempt))
                    continue
            except (OSError, KeyError, IndexError, ValueError) as e:
                self.error = f"{type(e).__name__}: {e}"
            if attempt < c.retries:
                self.sleep(2**attempt)
        return ""


def diagnose(status: int) -> str:
    return {401: "the key was refused", 403: "access was refused", 404: "no such model or path", 429: "too many requests"}.get(status, f"HTTP status {status}")


#: Statuses of answers that need not be asked for again.
GOOD = ("ok", "repaired", "salvaged")


def window(table: DataFrame, workers: int | None) -> tuple[DataFrame, int]:
    """``table`` dealt to tasks, and the requests that each has in flight, so that there are ``workers`` at a time in all.

    Without ``workers`` the table's own partitions have one each.
    """
    if not workers:
        return table, 1
    tasks = min(workers, max(1, table.sparkSession.sparkContext.defaultParallelism))
    return table.repartition(tasks), workers // tasks


def in_flight(provider: Callable[[str], str], requests: Iterable[str], most: int) -> Iterator[tuple[str, str]]:
    """(answer, error) of each request in their order, with ``most`` of them under way.

    Each thread has a copy of the provider, whose error is then its own, and one that waits does not hold up others.
    """
    if most < 2:
        for r in requests:
            yield provider(r), getattr(provider, "error", "")
        return
    own = threading.local()

    def one(request: str) -> tuple[str, str]:
        if not hasattr(own, "provider"):
            own.provider = copy.copy(provider)
        return own.provider(request), getattr(own.provider, "error", "")

    with ThreadPoolExecutor(most) as pool:
        waiting: deque[Future] = deque()
        for r in requests:
            if len(waiting) == most:
                yield waiting.popleft().result()
            waiting.append(pool.submit(one, r))
        while waiting:
            yield waiting.popleft().result()


def responses(chunks: DataFrame, provider: Callable[[str], str], prompt: str = PROMPT, workers: int | None = None) -> DataFrame:
    """(doc_ord, chunk_idx, raw, status, error, json): one request per chunk; ``workers`` is the number of requests at a time.

    The status tells failed requests and answers from empty graphs, so they can be made again; ``error`` says what
    went wrong, in the provider's words (its ``error``) where there was no answer.
    """

    source, most = window(chunks.select(F.col("doc_ord").cast("long"), F.col("chunk_idx").cast("int"), "text"), workers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, told in in_flight(provider, (f"{prompt}\n\n{text}" if prompt else text for text in b.column(2).to_pylist()), most):
                value, status = parse(raw)
                body, status = as_text(value, status)
                # an answer that is no object is an empty graph with a status of its own
                error = None
                if not raw:
                    status, error = "no_answer", told or "empty answer"
                elif status == "failed":
                    error = "the answer holds no JSON"
                elif not isinstance(value, dict):
                    status, body, error = "not_an_object", None, f"the answer is of type {type(value).__name__}"
                out.append((raw, status, error, body))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 4))], names=["doc_ord", "chunk_idx", "raw", "status", "error", "json"])

    return source.mapInArrow(run, "doc_ord long, chunk_idx int, raw string, status string, error string, json string")


def todo(chunks: DataFrame, done: DataFrame, config_hash: str) -> DataFrame:
    """Chunks without a good answer under this configuration."""
    good = done.where((F.col("config_hash") == config_hash) & F.col("status").isin(*GOOD))
    return chunks.join(good, ["doc_ord", "chunk_idx"], "left_anti")


def graph_rows(parsed: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graphs as JSON, one per row of (doc_ord, graph_ord, ...)."""
    g = parsed.select("doc_ord", "graph_ord", F.from_json(json_col, GRAPH).alias("g"))
    nodes = g.select("doc_ord", "graph_ord", F.posexplode("g.nodes").alias("node_ord", "n")).select("doc_ord", "graph_ord", "node_ord", F.col("n.id").alias("orig_id"), "n.label", "n.type", "n.properties", "n.description")
    edges = g.select("doc_ord", "graph_ord", F.posexplode("g.edges").alias("edge_ord", "e")).select("doc_ord", "graph_ord", "edge_ord", "e.source", "e.target", "e.type", "e.label", "e.properties", "e.evidence")
    return nodes, edges


def rule_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes: words of four letters and more that begin with a capital; edges: from each to the next.  Built-in functions only."""
    words = chunks.select("doc_ord", "chunk_idx", F.posexplode(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]{3,})"), 1)).alias("pos", "word"))
    empty = F.expr("cast(map() as map<string,string>)")
    nodes = words.select("doc_ord", F.col("chunk_idx").alias("graph_ord"), F.col("pos").alias("node_ord"), F.lower("word").alias("orig_id"), F.col("word").alias("label"), F.lit("Term").alias("type"), empty.alias("properties"), F.lit("").alias("description"))
    after = F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]{3,})"), 1)
    pair = F.arrays_zip(F.slice(after, 1, F.greatest(F.size(after) - 1, F.lit(0))).alias("a"), F.slice(after, 2, F.greatest(F.size(after) - 1, F.lit(0))).alias("b"))
    edges = chunks.select("doc_ord", F.col("chunk_idx").alias("graph_ord"), F.posexplode(pair).alias("edge_ord", "p")).select("doc_ord", "graph_ord", "edge_ord", F.lower("p.a").alias("source"), F.lower("p.b").alias("target"), F.lit("NEXT_TO").alias("type"), F.lit("").alias("label"), empty.alias("properties"), F.concat_ws(" ", "p.a", "p.b").alias("evidence"))
    return nodes, edges
