"""Checkpoints and connected components over DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder in ``spark.checkpoint.dir``.

    Where the session names no such folder (as in local tests) one is made, since
    driver and executors then share a machine.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        to = sc.getConf().get("spark.checkpoint.dir")
        if to is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            to = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(to)
    return df.checkpoint(eager=True)


def _print(edges: DataFrame) -> tuple:
    """What tells one edge set from another."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def contract(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge list (u, v), the smallest node of its component.

    Alternates large-star and small-star steps: each hooks a node's neighbours to
    the smallest of them, so the number of rounds grows with the logarithm of
    the component's size and the number of edges never grows.  Minima are combined
    before the shuffle; the joins are plain equi-joins, which adaptive execution
    splits where a node has very many neighbours.
    """
    e = kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _print(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _print(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
