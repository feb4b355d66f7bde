"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (u, v): root is the smallest node of its component.

    Every round points nodes at the least root among their neighbours' and then at their roots' own, until none changes.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = materialize(both)
    state = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")).withColumnRenamed("u", "node"))
    while True:
        seen = both.join(state.withColumnsRenamed({"node": "v", "root": "_r"}), "v").groupBy("u").agg(F.min("_r").alias("_r")).withColumnRenamed("u", "node")
        hooked = state.join(seen, "node").select("node", "root", F.least("root", "_r").alias("_up"))
        # a root that one of its nodes left takes the least of what they found
        moved = hooked.groupBy("root").agg(F.min("_up").alias("_new"))
        step = hooked.join(moved, "root").select("node", F.col("root").alias("_old"), F.least("_up", "_new").alias("root"))
        jump = step.join(step.select(F.col("node").alias("root"), F.col("root").alias("_top")), "root", "left").select("node", "_old", F.least(F.coalesce("_top", "root"), "root").alias("root"))
        after = materialize(jump)
        if after.where("_old <> root").isEmpty():
            return after.select("node", "root")
        state = after.select("node", "root")
