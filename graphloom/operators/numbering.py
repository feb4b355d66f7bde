"""Ordinals over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import materialize


def numbered(table: DataFrame, order: list[str]) -> DataFrame:
    """``ord`` from 1 in the given order.

    Ranges of the order are counted and offset, so no task sees more than its range.
    """
    spark = table.sparkSession
    ranged = materialize(table.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order).withColumn("_mi", F.monotonically_increasing_id()))
    part = F.shiftright("_mi", 33)
    # one number per partition
    counts = {r[0]: r[1] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part) if before else F.lit(0)
    return ranged.withColumn("ord", (offset + F.col("_mi").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_mi")
