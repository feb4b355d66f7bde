"""What a run did, counted on the way by observations, so that no job is run for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.providers import GOOD


class RunMetrics:
    """Counts: chunks, failed answers, edges before and after pruning, edges enriched, edges found invalid.

    A count is there once an action has gone over its table; ``values`` waits for those that were begun.
    """

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def _observe(self, table: DataFrame, name: str, **counts: Column) -> DataFrame:
        self._seen[name] = Observation(name)
        return table.observe(self._seen[name], *[c.alias(k) for k, c in counts.items()])

    def answers(self, table: DataFrame) -> DataFrame:
        return self._observe(table, "answers", chunks=F.count(F.lit(1)), failed=F.count_if(~F.col("status").isin(*GOOD)))

    def before_pruning(self, table: DataFrame) -> DataFrame:
        return self._observe(table, "before_pruning", edges_merged=F.count(F.lit(1)))

    def after_pruning(self, table: DataFrame) -> DataFrame:
        return self._observe(table, "after_pruning", edges_kept=F.count(F.lit(1)))

    def enriched(self, table: DataFrame, changed: Column) -> DataFrame:
        return self._observe(table, "enriched", edges_enriched=F.count_if(changed))

    def verified(self, table: DataFrame, invalid: Column) -> DataFrame:
        return self._observe(table, "verified", edges_invalid=F.count_if(invalid))

    def values(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for o in self._seen.values():
            out |= o.get
        if "edges_merged" in out and "edges_kept" in out:
            out["edges_removed"] = out["edges_merged"] - out["edges_kept"]
        return out


def run_metrics(merged: DataFrame, pruned: DataFrame, enriched: DataFrame, verified: DataFrame, keys: list[str]) -> DataFrame:
    """One row (removed, enriched, invalid) from the edge tables of a run, told apart by ``keys``.

    An edge is enriched if its type or label differs from the pruned one's, invalid if it is in ``enriched`` and not in ``verified``.
    """
    flag = lambda df, name: df.select(*keys).withColumn(name, F.lit(1))
    after = enriched.select(*keys, F.struct("type", "label").alias("_new"))
    rows = merged.select(*keys).join(pruned.select(*keys, F.struct("type", "label").alias("_old")), keys, "left").join(after, keys, "left").join(flag(verified, "_ok"), keys, "left")
    return rows.agg(F.count_if(F.col("_old").isNull()).alias("removed"), F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("enriched"), F.count_if(F.col("_new").isNotNull() & F.col("_ok").isNull()).alias("invalid"))
