"""Predicate search, text search, subgraphs and confidence filters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.operators.graph import KG, with_endpoints
from graphwright.schema import json_text, plain_text

_ENTITY_KEYS = {"entity_type": "entity_type", "type": "entity_type"}
_REL_KEYS = {
    "relation_type": "relation_type", "type": "relation_type", "source_entity": "source_entity", "source": "source_entity",
    "target_entity": "target_entity", "target": "target_entity", "bidirectional": "bidirectional",
}


def _range(column: str, value: Any) -> Column:
    """Equality with a number, or the bounds {min, max}."""
    c = F.col(column)
    if not isinstance(value, dict):
        return c == F.lit(float(value))
    parts = [c >= F.lit(float(value["min"]))] if "min" in value else []
    parts += [c <= F.lit(float(value["max"]))] if "max" in value else []
    return reduce(Column.__and__, parts, F.lit(True))


def _name(value: Any) -> Column:
    c = F.col("name")
    if not isinstance(value, dict):
        return c == value
    tests = {"contains": c.contains, "exact": lambda v: c == v, "regex": c.rlike}
    return reduce(Column.__and__, [tests[k](v) for k, v in value.items() if k in tests], F.lit(True))


def _attribute(key: str, value: Any, required: bool) -> Column:
    """Equality of an attribute; a missing key fails if required, else passes."""
    equal = F.element_at("attributes", key) == json_text(value)
    has = F.coalesce(F.map_contains_key("attributes", key), F.lit(False))
    return has & F.coalesce(equal, F.lit(False)) if required else ~has | F.coalesce(equal, F.lit(False))


def _predicate(query: dict[str, Any], plain: dict[str, str], special: dict[str, Callable[[Any], Column]]) -> Column:
    parts = []
    for key, value in query.items():
        if key in plain:
            parts.append(F.col(plain[key]) == value)
        elif key in special:
            parts.append(special[key](value))
        elif key == "attributes":
            parts += [_attribute(k, v, True) for k, v in value.items()]
        else:
            parts.append(_attribute(key, value, False))
    return reduce(Column.__and__, parts, F.lit(True))


def entity_predicate(query: dict[str, Any]) -> Column:
    """A query dictionary as one condition, which reaches the scan where the source allows it."""
    return _predicate(query, _ENTITY_KEYS, {"name": _name, "confidence": lambda v: _range("confidence", v)})


def relationship_predicate(query: dict[str, Any]) -> Column:
    ranges = {c: (lambda v, c=c: _range(c, v)) for c in ("confidence", "strength")}
    return _predicate(query, _REL_KEYS, ranges)


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    return df.orderBy("ord").limit(limit) if limit else df


def find_entities(kg: KG, query: dict[str, Any], limit: int | None = None) -> DataFrame:
    """Entities that meet all conditions; with a limit, the first ones inserted."""
    return _limited(kg.nodes.where(entity_predicate(query)), limit)


def find_relationships(kg: KG, query: dict[str, Any], limit: int | None = None) -> DataFrame:
    return _limited(kg.rels.where(relationship_predicate(query)), limit)


def query_graph(kg: KG, query: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """The same query against entities and relationships."""
    return find_entities(kg, query), find_relationships(kg, query)


def _text_condition(pattern: str, fields: list[str], named: bool) -> Column:
    parts = [F.col(c).rlike(pattern) for c in ("name", "context") if c in fields and (named or c != "name")]
    if "attributes" in fields:
        # A string value is searched as its text, a list item by item; numbers and booleans are not searched.
        hit = lambda v: F.when(v.startswith('"'), plain_text(v).rlike(pattern)).when(
            v.startswith("["), F.exists(F.coalesce(F.from_json(v, "array<string>"), F.array()), lambda x: x.rlike(pattern))
        ).otherwise(False)
        parts.append(F.exists(F.map_values("attributes"), hit))
    return reduce(Column.__or__, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(False))


def search_text(
    kg: KG, text: str, search_in: list[str] | None = None, entity_types: list[str] | None = None, case_sensitive: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) where the regular expression ``text`` is found in name, context or attributes.

    The type filter applies to entities alone; relationships have no name.
    """
    fields = search_in or ["name", "context", "attributes"]
    pattern = text if case_sensitive else f"(?iu){text}"
    nodes = kg.nodes.where(_text_condition(pattern, fields, True))
    if entity_types:
        nodes = nodes.where(F.col("entity_type").isin(entity_types))
    return nodes, kg.rels.where(_text_condition(pattern, fields, False))


def subgraph(kg: KG, ids: list[str] | DataFrame, include_neighbors: bool = False, max_relationships: int | None = 100) -> KG:
    """The graph induced by ``ids`` (and their neighbours); at most the first ``max_relationships`` relationships."""
    seeds = ids.select("id").distinct() if isinstance(ids, DataFrame) else kg.nodes.where(F.col("id").isin(list(ids))).select("id")
    chosen = seeds
    if include_neighbors:
        ends = [("source_entity", "target_entity"), ("target_entity", "source_entity")]
        near = [kg.rels.join(seeds.withColumnRenamed("id", a), a, "left_semi").select(F.col(b).alias("id")) for a, b in ends]
        chosen = seeds.unionByName(near[0]).unionByName(near[1]).distinct()
    nodes = kg.nodes.join(chosen, "id", "left_semi")
    rels = _limited(with_endpoints(kg.rels, nodes), max_relationships)
    return replace(kg, name=f"subgraph_{kg.name}", entities=nodes, relationships=rels, unique=True)


def filter_by_confidence(kg: KG, least: float = 0.5, apply_to: str = "both") -> KG:
    """Entities and/or relationships of at least that confidence; relationships always need both endpoints."""
    sure = F.col("confidence") >= F.lit(float(least))
    nodes = kg.nodes.where(sure) if apply_to in ("entities", "both") else kg.nodes
    rels = kg.rels.where(sure) if apply_to in ("relationships", "both") else kg.rels
    return replace(kg, name=f"filtered_{kg.name}", entities=nodes, relationships=with_endpoints(rels, nodes), unique=True)
