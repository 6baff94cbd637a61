"""Declared schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

NODE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("citation", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("jurisdiction_level", T.StringType(), False),
    T.StructField("parent_id", T.StringType()),
    T.StructField("full_text", T.StringType(), False),
    T.StructField("ai_summary", T.StringType()),
    T.StructField("is_public", T.BooleanType(), False),
    T.StructField("sort_order", T.LongType(), False),
    T.StructField("summary_status", T.StringType(), False),
])

EDGE = T.StructType([T.StructField("from_id", T.StringType(), False), T.StructField("to_id", T.StringType(), False)])
VECTOR = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("chunk_index", T.IntegerType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()), False)])
NEIGHBOR = T.StructType([T.StructField("id", T.StringType()), T.StructField("neighbor_id", T.StringType()), T.StructField("score", T.FloatType()), T.StructField("rank", T.IntegerType())])
CHANGE = T.StructType([T.StructField("change_id", T.LongType()), T.StructField("node_id", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("change_type", T.StringType())])
CHUNK = T.StructType([T.StructField("id", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("text_hash", T.StringType())])
MANIFEST = T.MapType(T.StringType(), T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("ruleVersionId", T.StringType()), T.StructField("effective_date", T.StringType()), T.StructField("as_of", T.StringType()),
    T.StructField("permits", T.MapType(T.StringType(), T.StructType([T.StructField("issuance", T.StringType()), T.StructField("date", T.StringType()), T.StructField("docid", T.StringType())]))),
]))
#: Every label that a log row may carry.
CHANGE_TYPES = [
    "text_updated", "links_updated", "added", "removed", "transcription_corrected", "duplicate_removed", "source_version_changed",
    "summary_approved", "summary_edited", "summary_regenerated",
]


def columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields]
