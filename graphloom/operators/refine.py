"""Enrichment of vague edges and verification of edges with a model."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonrepair import parse
from ..functions.text import relation_type, strip
from ..progress import add, best, good, stored
from ..schema import ENRICHED_ITEM, GENERIC_TYPES, VERDICT
from ..sources.providers import in_flight, provider_name, window
from .materialize import materialize
from .resolve import prune


def needs_enrichment(all_typed: bool = False):
    """Edges with a generic type or without a label; ``all_typed`` takes every edge that has a type as well."""
    vague = (strip(F.col("label")) == "") | F.upper(strip(F.col("type"))).isin(*GENERIC_TYPES)
    return vague | (F.coalesce("type", F.lit("")) != "") if all_typed else vague


def batched(edges: DataFrame, size: int, part: str = "graph_ord") -> DataFrame:
    """``batch`` and ``pos`` within it, in edge order within ``part``."""
    n = F.row_number().over(Window.partitionBy(part).orderBy("edge_ord")) - 1
    return edges.withColumn("_n", n).withColumns({"batch": F.floor(F.col("_n") / size), "pos": F.col("_n") % size}).drop("_n")


def with_labels(nodes: DataFrame, edges: DataFrame, missing: str | None = None) -> DataFrame:
    """Edges with the labels of their ends; unknown ends show ``missing`` or their id."""
    out = edges
    for end in ("source", "target"):
        ids = nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        out = out.join(ids, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", F.lit(missing) if missing else F.col(end)))
    return out


def like(properties: Column, have: T.MapType, want: T.MapType) -> Column:
    """Properties with values of the type that ``want`` has; JSON values of any type stay what they are in a variant."""
    return properties if have.valueType == want.valueType else F.transform_values(properties, lambda _, v: v.cast(want.valueType))


def overlaid(old: Column, new: Column) -> Column:
    """``old`` properties with those of ``new`` in their place, key by key; values are replaced whole, also by nulls."""
    stays = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.when(F.size(F.coalesce(F.map_keys(new), F.array())) > 0, F.coalesce(F.map_concat(stays, new), new)).otherwise(old)


def apply_enrichment(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Edges (graph_ord, batch, pos, ...) with the replies (graph_ord, batch, items: array of ENRICHED_ITEM) to their batch.

    An item counts for the edge that ``_idx`` names in its own batch, else for the one at
    its place.  A new type counts if it is not generic, a label or properties if not empty.
    """
    flat = replies.select("graph_ord", "batch", F.posexplode("items").alias("_p", "_i"))
    item = flat.select("graph_ord", "batch", F.coalesce("_i._idx", "_p").cast("long").alias("pos"), "_p", "_i")
    item = item.groupBy("graph_ord", "batch", "pos").agg(F.max_by("_i", "_p").alias("_i"))
    return _changed(batches.withColumn("pos", F.col("pos").cast("long")).join(item, ["graph_ord", "batch", "pos"], "left"))


def _changed(joined: DataFrame) -> DataFrame:
    """Edges with what item ``_i`` says of them."""
    kind, label = relation_type(F.col("_i.type")), strip(F.col("_i.label"))
    merged = overlaid(F.col("properties"), like(F.col("_i.properties"), joined.schema["_i"].dataType["properties"].dataType, joined.schema["properties"].dataType))
    return joined.withColumns({"type": F.when((kind != "") & ~kind.isin(*GENERIC_TYPES), kind).otherwise(F.col("type")), "label": F.when(label != "", label).otherwise(F.col("label")), "properties": merged}).drop("_i")


def drop_invalid(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """Edges but for those that a reply (graph_ord, batch, items: array of VERDICT) calls invalid; no verdict keeps an edge."""
    bad = replies.select("graph_ord", "batch", F.explode("items").alias("_i")).where("NOT _i.valid").select("graph_ord", "batch", F.col("_i.idx").cast("long").alias("pos"))
    return batches.withColumn("pos", F.col("pos").cast("long")).join(bad, ["graph_ord", "batch", "pos"], "left_anti")


ENRICH = "Give each relation a precise upper-case verb as type and a label of at most five words. Answer with a JSON array of {_idx, type, label, properties}; _idx is the item's pos."
VERIFY = "For each relation say whether its evidence supports it. Answer with a JSON array of {idx, valid, reason}; idx is the item's pos."


FIELDS = ["source_label", "target_label", "type", "label", "evidence"]
REPLIES = "key string, item string, status string, error string"


def edge_key(settings: str, prompt: str) -> Column:
    """What is asked of an edge and of whom, as a hash; where the edge stands does not matter."""
    return F.sha2(F.to_json(F.struct(F.lit(settings).alias("settings"), F.lit(prompt).alias("prompt"), *FIELDS), {"ignoreNullFields": "false"}), 256)


def _items(value: object, index: str, by_place: bool) -> dict[int, dict]:
    """The items of a reply by the place in the batch that they name, else by their own place if ``by_place``; later ones count."""
    found = value if isinstance(value, list) else value.get("edges") if isinstance(value, dict) else None
    out = {}
    for place, item in enumerate(found if isinstance(found, list) else []):
        if isinstance(item, dict):
            at = item.get(index)
            at = place if at is None and by_place else at
            if isinstance(at, int) and not isinstance(at, bool):
                out[at] = item
    return out


def ask(batches: DataFrame, provider, prompt: str, index: str = "_idx", by_place: bool = True, workers: int | None = None) -> DataFrame:
    """One request per batch of edges (key, graph_ord, batch, pos, ...): (key, item, status, error) of each edge.

    ``item`` is what the reply says of the edge, as JSON, null if it says nothing.  A batch without a reply that can be read has a status that is not good.
    """
    requests = batches.groupBy("graph_ord", "batch").agg(F.sort_array(F.collect_list(F.struct("pos", *FIELDS, "key"))).alias("e"))
    requests = requests.select("graph_ord", "batch", F.to_json(F.transform("e", lambda x: F.struct(x["pos"].alias("pos"), *[x[c].alias(c) for c in FIELDS]))).alias("body"), F.col("e.key").alias("keys"))
    source, most = window(requests, workers)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for (raw, told), keys in zip(in_flight(provider, (f"{prompt}\n{body}" for body in b.column(2).to_pylist()), most), b.column(3).to_pylist()):
                value, status = parse(raw)
                error = None if status != "failed" else "the answer holds no JSON" if raw else told or "empty answer"
                said = _items(value, index, by_place)
                rows += [(key, json.dumps(said[i]) if i in said else None, status if raw else "no_answer", error) for i, key in enumerate(keys)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 4)], names=["key", "item", "status", "error"])

    return source.mapInArrow(run, REPLIES)


def replies(edges: DataFrame, provider, prompt: str, size: int, index: str = "_idx", by_place: bool = True, settings: str = "", folder: str = "", resume: bool = True, workers: int | None = None) -> DataFrame:
    """(graph_ord, edge_ord, item, status, error): what the provider says of ``edges`` (graph_ord, edge_ord, FIELDS), each batch of ``size`` asked once.

    Replies are kept by edge as soon as they are there, under ``folder`` or else for this run, so no action asks again.
    With ``resume`` edges that have a good reply to the same question are not asked about, whatever batch they were in.
    Edges of which the same is asked share a reply.
    """
    settings = f"{provider_name(provider)} {settings}"
    edges = materialize(edges.select("graph_ord", "edge_ord", edge_key(settings, prompt).alias("key"), *FIELDS))
    todo = edges.groupBy("key").agg(F.min(F.struct("graph_ord", "edge_ord", *FIELDS)).alias("e")).select("key", "e.*")
    if folder and resume:
        before = stored(edges.sparkSession, folder, REPLIES, tell=True)
        todo = todo.join(before.where(good(before)).select("key"), "key", "left_anti")
    todo = materialize(batched(todo, size))
    make = lambda some: ask(some, provider, prompt, index, by_place, workers)
    if folder:
        add(todo, ["graph_ord", "batch"], make, folder)
        now = stored(edges.sparkSession, folder, REPLIES)
    else:
        now = materialize(make(todo))
    return edges.select("graph_ord", "edge_ord", "key").join(best(now, ["item", "status", "error"]), "key").drop("key")


def enrich(nodes: DataFrame, edges: DataFrame, provider, size: int = 30, metrics=None, **how) -> DataFrame:
    """Edges with vague ones enriched, pruned again since new types can make equal triples; ``how``: see ``replies``."""
    vague = with_labels(nodes, edges.where(needs_enrichment()))
    got = replies(vague, provider, ENRICH, size, **how)
    items = got.where("item IS NOT NULL").select("graph_ord", "edge_ord", F.from_json("item", ENRICHED_ITEM).alias("_i"))
    better = _changed(vague.withColumn("_old", F.struct("type", "label")).join(items, ["graph_ord", "edge_ord"], "left"))
    if metrics:
        better = metrics.enriched(better, ~F.col("_old").eqNullSafe(F.struct("type", "label")))
    return prune(nodes, edges.where(~F.coalesce(needs_enrichment(), F.lit(False))).unionByName(better.select(edges.columns)))


def verify(nodes: DataFrame, edges: DataFrame, provider, size: int = 20, metrics=None, **how) -> DataFrame:
    """Edges without those that the provider calls invalid; no verdict keeps an edge; ``how``: see ``replies``."""
    got = replies(with_labels(nodes, edges, "?"), provider, VERIFY, size, index="idx", by_place=False, **how)
    bad = got.select("graph_ord", "edge_ord", F.from_json("item", VERDICT).alias("_i")).where("NOT _i.valid").select("graph_ord", "edge_ord", F.lit(True).alias("_bad"))
    told = edges.join(bad, ["graph_ord", "edge_ord"], "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)))
    if metrics:
        told = metrics.verified(told, F.col("_bad"))
    return told.where("NOT _bad").select(edges.columns)
