"""Registries: de-duplication and merging of entities and relationships."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.operators.graph import latest
from graphwright.schema import ENTITIES, json_text


def normalize_name(name: Column) -> Column:
    return F.trim(F.lower(name))


def merge_groups(entities: DataFrame, key: list[str]) -> DataFrame:
    """One entity per key.

    The earliest row gives id and type; the most certain (ties: earliest) the name;
    distinct contexts are joined by line feeds in order; metadata keep the earliest
    value of a key; an attribute with one value keeps it, different values become
    one flat list of distinct items in order.  Contexts and attribute values are
    made distinct before they are gathered, so a name shared by very many rows
    gathers only what differs.
    """
    k = [F.col(c).alias(f"__k{i}") for i, c in enumerate(key)]
    keys = [f"__k{i}" for i in range(len(key))]
    rows = entities.select(*k, "*")
    base = rows.groupBy(*keys).agg(
        F.min_by("id", "ord").alias("id"), F.max_by("name", F.struct("confidence", -F.col("ord"))).alias("name"),
        F.min_by("entity_type", "ord").alias("entity_type"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord"),
    )
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("o", c))), lambda x: x[c])
    contexts = rows.where("context is not null and context <> ''").groupBy(*keys, "context").agg(F.min("ord").alias("o"))
    contexts = contexts.groupBy(*keys).agg(F.array_join(ordered("context"), "\n").alias("context"))
    pairs = rows.select(*keys, "ord", F.explode("attributes").alias("key", "value"))
    whole = pairs.groupBy(*keys, "key", "value").agg(F.min("ord").alias("o"))
    single = whole.groupBy(*keys, "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "o").alias("value"))
    items = whole.select(*keys, "key", "o", F.posexplode(F.coalesce(F.when(F.col("value").startswith("["), split_items(F.col("value"))), F.array("value"))).alias("i", "item"))
    items = items.groupBy(*keys, "key", "item").agg(F.min(F.struct("o", "i")).alias("o"))
    lists = items.groupBy(*keys, "key").agg(F.concat(F.lit("["), F.array_join(ordered("item"), ","), F.lit("]")).alias("list"))
    value = F.when(F.col("n") == 1, F.col("value")).otherwise(F.col("list"))
    entry = F.collect_list(F.struct("key", value.alias("value")))
    attributes = single.join(lists, [*keys, "key"]).groupBy(*keys).agg(F.map_from_entries(F.array_sort(entry)).alias("attributes"))
    meta = rows.select(*keys, "ord", F.explode("metadata").alias("key", "value")).groupBy(*keys, "key").agg(F.min_by("value", "ord").alias("value"))
    meta = meta.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    for part in (contexts, attributes, meta):
        base = base.join(part, keys, "left")
    empty = F.create_map().cast("map<string,string>")
    return base.select(
        "id", "name", "entity_type", "context", F.coalesce("attributes", empty).alias("attributes"), F.coalesce("metadata", empty).alias("metadata"), "confidence", "ord"
    )


def split_items(value: Column) -> Column:
    """The items of a JSON list as JSON texts; null where the text is not a list."""
    parsed = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "struct<v:array<variant>>").getField("v")
    return F.transform(parsed, lambda x: F.to_json(x))


def deduplicate(entities: DataFrame) -> DataFrame:
    """Entities merged by id, then by (normalised name, type)."""
    by_id = merge_groups(entities, ["id"])
    keyed = by_id.withColumn("__name", normalize_name(F.col("name")))
    return merge_groups(keyed.select("__name", *by_id.columns), ["__name", "entity_type"])


def id_map(entities: DataFrame) -> DataFrame:
    """``(old_id, new_id)``: where each entity went in :func:`deduplicate`."""
    key = ["__name", "entity_type"]
    rows = entities.withColumn("__name", normalize_name(F.col("name")))
    first = rows.groupBy(*key).agg(F.min_by("id", "ord").alias("new_id"))
    return rows.join(first, key).select(F.col("id").alias("old_id"), "new_id").distinct()


def repoint(relationships: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relationships whose endpoints follow ``(old_id, new_id)``."""
    out = relationships
    for c in ("source_entity", "target_entity"):
        side = mapping.select(F.col("old_id").alias(c), F.col("new_id").alias("__new"))
        out = out.join(side, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return out.select(*relationships.columns)


def _fold_value(a, b):
    if a == b and type(a) is type(b):
        return a
    if isinstance(a, list) and isinstance(b, list):
        return a + [x for x in b if x not in a]
    return [a, b]


def fold_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Parity mode of merging for one bounded group: pairwise, so attribute lists may nest."""
    rows = rows.sort_values("ord", kind="stable")
    first = rows.iloc[0]
    name, sure, contexts = first["name"], first["confidence"], [first["context"]] if first["context"] else []
    attributes = {k: json.loads(v) for k, v in dict(first["attributes"] or {}).items()}
    metadata = dict(first["metadata"] or {})
    for _, row in rows.iloc[1:].iterrows():
        name = name if sure >= row["confidence"] else row["name"]
        sure = max(sure, row["confidence"])
        if row["context"] and row["context"] not in contexts:
            contexts.append(row["context"])
        for k, v in dict(row["attributes"] or {}).items():
            value = json.loads(v)
            attributes[k] = _fold_value(attributes[k], value) if k in attributes else value
        metadata = {**dict(row["metadata"] or {}), **metadata}
    return pd.DataFrame([{
        "id": first["id"], "name": name, "entity_type": first["entity_type"], "context": "\n".join(contexts) or None,
        "attributes": {k: json_text(v) for k, v in attributes.items()}, "metadata": metadata, "confidence": sure, "ord": first["ord"],
    }])


def deduplicate_parity(entities: DataFrame) -> DataFrame:
    """As :func:`deduplicate`, with the pairwise fold; for groups that fit a task."""
    key = normalize_name(F.col("name")).alias("__name")
    return entities.groupBy(key, "entity_type").applyInPandas(lambda rows: fold_group(rows), ENTITIES)


def find_by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.where(normalize_name(F.col("name")) == name.lower().strip())


def find_by_type(entities: DataFrame, entity_type: str) -> DataFrame:
    return entities.where(F.col("entity_type") == entity_type)


def add_relationships(old: DataFrame, new: DataFrame) -> DataFrame:
    """Last write per id; equal (source, target, type) under other ids stay apart."""
    return latest(old.unionByName(new), ["id"], ["ord"])


def find_relationships(rels: DataFrame, *, source: str | None = None, target: str | None = None, entity: str | None = None, relation_type: str | None = None) -> DataFrame:
    """Relationships by source, target, either end (a self-loop once) or type."""
    if source is not None:
        rels = rels.where(F.col("source_entity") == source)
    if target is not None:
        rels = rels.where(F.col("target_entity") == target)
    if entity is not None:
        rels = rels.where((F.col("source_entity") == entity) | (F.col("target_entity") == entity))
    return rels.where(F.col("relation_type") == relation_type) if relation_type is not None else rels
