"""Schemas of the logical tables. Ids are strings derived from natural keys, so that they are the same on every run."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_MAP = T.MapType(_S, _S)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


WORKSPACES = _schema(("id", _S), ("name", _S), ("settings", _MAP), ("created_at", _TS))
SOURCES = _schema(("id", _S), ("name", _S), ("type", _S), ("config", _MAP), ("status", _S), ("tenant_id", _S), ("freshness_sla_seconds", _L), ("last_sync_at", _TS), ("created_at", _TS))
DOCUMENTS = _schema(("id", _S), ("source_id", _S), ("external_id", _S), ("uri", _S), ("title", _S), ("content_hash", _S), ("doc_version", _L), ("metadata", _MAP), ("indexed_at", _TS), ("tombstoned_at", _TS))
CHUNKS = _schema(("id", _S), ("document_id", _S), ("ord", _I), ("text", _S), ("embedding", T.ArrayType(T.FloatType())), ("symbol", _S), ("ingestion_run_id", _S), ("embedding_model", _S), ("embedding_provider", _S), ("parser_version", _S), ("chunker_strategy", _S), ("metadata", _MAP))
RUNS = _schema(("id", _S), ("source_id", _S), ("status", _S), ("started_at", _TS), ("finished_at", _TS), ("docs_new", _L), ("docs_updated", _L), ("docs_removed", _L), ("errors", _MAP))
TOKENS = _schema(("id", _S), ("name", _S), ("prefix", _S), ("hash", _S), ("scopes", T.ArrayType(_S)), ("workspace_id", _S), ("expires_at", _TS), ("is_active", _B))
ENTITIES = _schema(("id", _S), ("source_id", _S), ("entity_type", _S), ("name", _S), ("display_name", _S), ("chunk_id", _S), ("metadata", _MAP))
EDGES = _schema(("id", _S), ("source_entity_id", _S), ("target_entity_id", _S), ("edge_type", _S), ("metadata", _MAP))
#: ``seq`` orders the events of a document, ``attempt`` counts deliveries.
CHANGE_EVENTS = _schema(("source_id", _S), ("source_type", _S), ("external_id", _S), ("uri", _S), ("action", _S), ("seq", _L), ("attempt", _L))
SECTION = _schema(("heading_path", T.ArrayType(_S)), ("text", _S), ("line_start", _I), ("line_end", _I), ("symbol", _S), ("metadata", _MAP))

#: Fixed values.
SOURCE_TYPES = ["git", "fs", "confluence", "notion", "slack", "jira", "grafana", "k8s", "terraform"]
SOURCE_STATUS = ["active", "paused", "error"]
RUN_STATUS = ["running", "ok", "partial", "error"]
