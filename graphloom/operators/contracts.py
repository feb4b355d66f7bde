"""Whether graphs keep to what the prompt asks for; nothing is dropped or changed for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.providers import NODE_TYPES

MOST_PROPERTIES, MOST_LABEL_WORDS = 5, 5


def _faults(checks: dict[str, Column]) -> Column:
    """The names of the checks that are true, in their order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())


def node_faults(nodes: DataFrame) -> DataFrame:
    """Nodes with ``faults``: label (blank), type (not one of those asked for), properties (too many)."""
    text = lambda c: strip(F.col(c))
    return nodes.withColumn("faults", _faults({"label": text("label") == "", "type": ~F.lower(text("type")).isin(*NODE_TYPES), "properties": F.size(F.map_keys("properties")) > MOST_PROPERTIES}))


def edge_faults(edges: DataFrame) -> DataFrame:
    """Edges with ``faults``: type (not upper case with underscores), label (too many words), evidence (none)."""
    text = lambda c: strip(F.col(c))
    return edges.withColumn("faults", _faults({"type": ~text("type").rlike("^[A-Z]+(_[A-Z]+)*$"), "label": F.size(F.filter(F.split(text("label"), r"\s+"), lambda x: x != "")) > MOST_LABEL_WORDS, "evidence": text("evidence") == ""}))
