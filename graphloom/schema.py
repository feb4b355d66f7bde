"""Row shapes of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

PROPERTIES = T.MapType(T.StringType(), T.VariantType())
NODE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "label", "type")] + [T.StructField("properties", PROPERTIES), T.StructField("description", T.StringType())])
EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "target", "type", "label")] + [T.StructField("properties", PROPERTIES), T.StructField("evidence", T.StringType())])
GRAPH = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("edges", T.ArrayType(EDGE))])
ENRICHED_ITEM = "_idx int, type string, label string, properties map<string,variant>"
VERDICT = "idx int, valid boolean, reason string"

DEFAULT_NODE_TYPE = "Nodo"
DEFAULT_EDGE_TYPE = "RELAZIONATO_A"
# Relation types that say nothing of the relation.
GENERIC_TYPES = ("RELAZIONATO_A", "CONNESSO_A", "ASSOCIATO_A", "COLLEGATO_A", "MENZIONA", "HA_RELAZIONE", "E_CONNESSO", "APPARTIENE", "RIFERITO_A", "LEGATO_A", "RELATED_TO", "CONNECTED_TO", "ASSOCIATED_WITH", "LINKED_TO", "MENTIONS")
