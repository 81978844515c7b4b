"""Table contracts, validation and the canonical text of attribute values."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITIES = (
    "id string, name string, entity_type string, context string, attributes map<string,string>, "
    "metadata map<string,string>, confidence double, ord bigint"
)
RELATIONSHIPS = (
    "id string, source_entity string, target_entity string, relation_type string, context string, "
    "attributes map<string,string>, metadata map<string,string>, bidirectional boolean, strength double, "
    "confidence double, ord bigint"
)
SEGMENTS = (
    "doc_id string, id string, parent_id string, level int, ord bigint, segment_type string, title string, "
    "text string, start int, end int, children_ids array<string>"
)
SUMMARIES = (
    "segment_id string, segment_type string, language string, summary string, key_points array<string>, "
    "role string, keywords array<string>"
)
ISSUES = "issue_type string, involved_elements array<string>, proposed_solution string, severity string, metadata map<string,string>"
SEVERITIES = ("critical", "medium", "low")


def json_text(value: Any) -> str:
    """Canonical JSON of an attribute value: equal texts mean equal values, and ``30`` differs from ``"30"``."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def json_map(values: dict[str, Any] | None) -> dict[str, str]:
    """Attributes as stored: each value as canonical JSON text."""
    return {k: json_text(v) for k, v in (values or {}).items()}


def plain_text(value: Column) -> Column:
    """The text of a JSON string value; other values as their JSON."""
    unquoted = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return F.when(value.startswith('"'), unquoted).otherwise(value)


def entity_frame(spark: SparkSession, rows: list[dict[str, Any]]) -> DataFrame:
    """Entities from dictionaries; ``type`` is accepted for ``entity_type``; ids default to the position."""
    out = []
    for ord_, row in enumerate(rows):
        out.append((
            row.get("id", f"e{ord_}"), row["name"], row.get("entity_type", row.get("type")), row.get("context"),
            json_map(row.get("attributes")), json_map(row.get("metadata")), float(row.get("confidence", 1.0)), int(row.get("ord", ord_)),
        ))
    return spark.createDataFrame(out, ENTITIES)


def relationship_frame(spark: SparkSession, rows: list[dict[str, Any]]) -> DataFrame:
    """Relationships from dictionaries; ``source``, ``target`` and ``type`` are accepted as short names."""
    out = []
    for ord_, row in enumerate(rows):
        out.append((
            row.get("id", f"r{ord_}"), row.get("source_entity", row.get("source")), row.get("target_entity", row.get("target")),
            row.get("relation_type", row.get("type", "related_to")), row.get("context"), json_map(row.get("attributes")),
            json_map(row.get("metadata")), bool(row.get("bidirectional", False)), float(row.get("strength", 1.0)),
            float(row.get("confidence", 1.0)), int(row.get("ord", ord_)),
        ))
    return spark.createDataFrame(out, RELATIONSHIPS)


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def _outside(c: str) -> Column:
    return ~F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))


def _split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("reason", reason)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def validate_entities(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``reason``): name and type non-empty, confidence in [0, 1]."""
    reason = F.when(_blank("name"), "empty name").when(_blank("entity_type"), "empty type").when(_outside("confidence"), "confidence outside [0, 1]")
    return _split(df, reason)


def validate_relationships(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``reason``): endpoints and type non-empty, strength and confidence in [0, 1]."""
    reason = (
        F.when(_blank("source_entity"), "empty source").when(_blank("target_entity"), "empty target")
        .when(_blank("relation_type"), "empty type").when(_outside("strength"), "strength outside [0, 1]")
        .when(_outside("confidence"), "confidence outside [0, 1]")
    )
    return _split(df, reason)
