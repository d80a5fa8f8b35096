"""Explicit schemas of the logical tables. JSON columns are typed arrays and structs."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, TS, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType(), T.BooleanType()
STRINGS = T.ArrayType(S)

TRUST_CHANGE = T.StructType([T.StructField("from", D), T.StructField("to", D), T.StructField("reason", S), T.StructField("at", TS)])

MEMORIES = T.StructType(
    [
        T.StructField("id", S, False),
        T.StructField("content", S),
        T.StructField("type_hint", S),
        T.StructField("source", S),
        T.StructField("tags", STRINGS),
        T.StructField("created_at", TS),
        T.StructField("updated_at", TS),
        T.StructField("last_accessed_at", TS),
        T.StructField("access_count", L),
        T.StructField("actor", S),
        T.StructField("actor_type", S),
        T.StructField("audience", S),
        T.StructField("project", S),
        T.StructField("session_id", S),
        T.StructField("agent_role", S),
        T.StructField("trust_level", D),
        T.StructField("knowledge_tier", S),
        T.StructField("source_ids", STRINGS),
        T.StructField("write_path", S),
        T.StructField("reply_to_id", S),
        T.StructField("event_time", TS),
        T.StructField("event_time_precision", S),
        T.StructField("deleted_at", TS),
        T.StructField("expires_at", TS),
        T.StructField("is_consolidated_original", B),
        T.StructField("abstract_text", S),
        T.StructField("overview_text", S),
        T.StructField("embedding_status", S),
        T.StructField("extraction_status", S),
        T.StructField("abstraction_status", S),
        T.StructField("normalization_status", S),
        T.StructField("entities", STRINGS),
        T.StructField("facts", STRINGS),
    ]
)

EMBEDDINGS = T.StructType([T.StructField("memory_id", S), T.StructField("embedding", T.ArrayType(D)), T.StructField("model_name", S), T.StructField("model_version", S), T.StructField("dimension", I), T.StructField("is_current", B), T.StructField("tier", S)])
SALIENCE = T.StructType([T.StructField("memory_id", S), T.StructField("stability", D), T.StructField("difficulty", D), T.StructField("reinforcement_count", L), T.StructField("last_reinforced_at", TS)])
ENTITIES = T.StructType([T.StructField("id", S), T.StructField("name", S), T.StructField("entity_type", S), T.StructField("aliases", STRINGS), T.StructField("first_seen_at", TS), T.StructField("last_seen_at", TS)])
RELATIONSHIPS = T.StructType([T.StructField("id", S), T.StructField("subject_id", S), T.StructField("object_id", S), T.StructField("predicate", S), T.StructField("relationship_type", S), T.StructField("weight", D), T.StructField("valid_from", TS), T.StructField("invalid_at", TS), T.StructField("superseded_by", S), T.StructField("source_memory_id", S), T.StructField("confidence", D)])
FACTS = T.StructType([T.StructField("id", S), T.StructField("entity_id", S), T.StructField("attribute", S), T.StructField("value", S), T.StructField("valid_from", TS), T.StructField("invalid_at", TS), T.StructField("source_memory_id", S), T.StructField("confidence", D)])
