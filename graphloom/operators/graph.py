"""Questions to a merged graph: nodes (ord, id, label, type, ...) and edges (source, target, type, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .materialize import materialize

# The viewer's palette.
PALETTE = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac", "#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#17becf")


def node_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce("type", F.lit("?")).alias("type")).agg(F.count("*").alias("n"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("id")).unionAll(edges.select(F.col("target").alias("id")))


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), "id", "left_anti")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated, and counts by type as maps."""
    as_map = lambda df, name: df.agg(F.coalesce(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))), F.expr("cast(map() as map<string,bigint>)")).alias(name))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(nodes, "nodes"), one(edges, "edges"), one(isolated_nodes(nodes, edges), "isolated"), as_map(node_type_counts(nodes), "node_types"), as_map(edge_type_counts(edges), "edge_types")]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        # each side is a single row
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counts = endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def parallel_edges(edges: DataFrame) -> DataFrame:
    """Edges with ``n_parallel`` and running ``parallel_idx`` within their unordered pair."""
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target"))
    order = pair.orderBy("graph_ord", "edge_ord")
    return edges.withColumns({"n_parallel": F.count("*").over(pair), "parallel_idx": F.row_number().over(order) - 1})


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(id, hop) of all nodes within ``k`` undirected steps of ``seeds`` (id), the seeds included."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("to")).unionAll(edges.select(F.col("target").alias("id"), F.col("source").alias("to")))
    seen = frontier = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, k + 1):
        frontier = both.join(frontier.select("id"), "id", "left_semi").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(hop))
        if hop < k:
            frontier = materialize(frontier)
        seen = seen.unionByName(frontier)
    return seen


def search(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose label holds ``text``, whatever the case; a blank search finds all."""
    wanted = text.strip().lower()
    return nodes.where(F.contains(F.lower("label"), F.lit(wanted))) if wanted else nodes


def of_types(nodes: DataFrame, types: list[str]) -> DataFrame:
    return nodes.where(F.col("type").isin(types)) if types else nodes


def without(nodes: DataFrame, ids: list[str]) -> DataFrame:
    return nodes.where(~F.col("id").isin(ids)) if ids else nodes


def type_colors(nodes: DataFrame) -> DataFrame:
    """(type, rank, color): the palette in order of first sight.  There are few types."""
    first = nodes.groupBy("type").agg(F.min("ord").alias("first"))
    rank = F.row_number().over(Window.orderBy("first")) - 1
    return first.select("type", rank.alias("rank")).withColumn("color", F.element_at(F.array(*map(F.lit, PALETTE)), F.col("rank") % len(PALETTE) + 1))


def legend(nodes: DataFrame) -> DataFrame:
    """(type, color), by type."""
    return type_colors(nodes).select("type", "color").orderBy("type")


def circle(nodes: DataFrame, radius: float = 300.0) -> DataFrame:
    """(id, x, y): nodes on a circle in their order, the viewer's first layout."""
    n = nodes.agg(F.count("*").alias("_n"))
    # one row
    angle = 2 * F.pi() * (F.col("ord") - 1) / F.col("_n")
    return nodes.select("id", "ord").join(F.broadcast(n)).select("id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def viewer_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.join(type_colors(nodes), "type").select("ord", "id", "label", "type", "color", F.col("description").alias("desc"), F.col("properties").alias("props"))


def viewer_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    known = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return known.select("source", "target", "type", "label", F.col("properties").alias("props"), "evidence")


def bounds(points: DataFrame) -> DataFrame:
    """One row: the box around (x, y)."""
    return points.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
