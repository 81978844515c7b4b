"""Extraction of entities and relationships from segments through a provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.operators.graph import KG
from graphwright.operators.provider import Provider, RuleProvider
from graphwright.operators.registry import deduplicate, normalize_name
from graphwright.plans.durable import durable
from graphwright.schema import json_text

#: Entity types that are asked for by default. Fixed values.
CONCEPTS = {
    "en": ("Person", "Organization", "Location", "Concept", "Process", "Method", "Technology", "Event", "Problem", "Solution", "Theory", "Argument"),
    "ru": ("Персона", "Организация", "Местоположение", "Концепция", "Процесс", "Метод", "Технология", "Событие", "Проблема", "Решение", "Теория", "Аргумент"),
}
RELATIONS = ("is-a", "part-of", "contains", "causes", "related-to", "works-for", "has-skill", "required-for", "precedes", "similar-to")

#: Characters of a context by which it meets texts, and how many contexts are looked for where the texts are.
GRAM, FEW_QUOTES = 24, 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

_RAW_ENTITIES = "segment_id string, place int, name string, entity_type string, context string, attributes map<string,string>, confidence double"
_RAW_RELATIONS = "segment_id string, place int, source_name string, target_name string, relation_type string, context string, bidirectional boolean, strength double, confidence double"


def extract_raw_entities(segments: DataFrame, provider: Callable[[], Provider] = RuleProvider, language: str = "en") -> DataFrame:
    """Provider answers as rows; one call per segment, one provider per partition."""
    types = list(CONCEPTS.get(language, CONCEPTS["en"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for batch in batches:
            out = []
            for segment, text in zip(batch["id"], batch["text"], strict=True):
                answer = model.generate_json(text or "", {"task": "entities", "types": types})
                for place, e in enumerate(answer.get("entities", [])):
                    attributes = e.get("attributes") or {}
                    if not isinstance(attributes, dict):
                        attributes = {"value": attributes}
                    if e.get("role"):
                        attributes["role"] = e["role"]
                    kind = e.get("entity_type", e.get("type"))
                    out.append((segment, place, e.get("name"), kind, e.get("context"), {k: json_text(v) for k, v in attributes.items()}, e.get("confidence")))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RAW_ENTITIES.split(", ")])

    return segments.select("id", "text").mapInPandas(run, _RAW_ENTITIES)


def entity_rows(raw: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Entities of raw answers: rows without name or type are skipped; the confidence defaults to 1.

    ``ord`` orders by segment and place through a hash of the segment id, so no
    global sort is needed; segment facts go to the metadata.
    """
    good = raw.where("coalesce(name, '') <> '' and coalesce(entity_type, '') <> ''")
    facts = F.map_from_arrays(F.array(F.lit("segment_id")), F.array(F.col("segment_id")))
    if segments is not None:
        side = segments.select(F.col("id").alias("segment_id"), "segment_type", F.col("level").cast("string").alias("level"), "title")
        good = good.join(side, "segment_id", "left")
        entries = [F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in (("segment_id", "segment_id"), ("segment_type", "segment_type"), ("segment_level", "level"), ("segment_title", "title"))]
        facts = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    ord_ = F.shiftleft(F.pmod(F.xxhash64("segment_id"), F.lit(1 << 42)), 20) + F.col("place")
    return good.select(
        F.concat(F.lit("e:"), "segment_id", F.lit(":"), "place").alias("id"), "name", "entity_type", "context", F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        facts.alias("metadata"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), ord_.alias("ord"),
    )


def entities_in_segments(segments: DataFrame, entities: DataFrame, strict: bool = False) -> DataFrame:
    """``(segment_id, entity_id, name)``: entities one of whose contexts occurs in the segment's text.

    Contexts of an entity are its lines; ``strict`` takes the whole text as one.  A
    context can only occur where it begins, so candidates meet on a rolling hash of its
    first ``GRAM`` characters, of which a text has one a character, found in one pass over
    it; containment is checked on the candidates.  Up to ``FEW_QUOTES`` hashes are
    looked for where the texts are; of more, the texts' hashes go to them.
    """
    quotes = F.array("context") if strict else F.split("context", "\n")
    held = entities.where("coalesce(context, '') <> ''").select(F.col("id").alias("entity_id"), "name", F.explode(quotes).alias("quote")).where("quote <> ''").distinct()
    held = durable(held, "quotes")
    long_ = held.where(F.length("quote") >= GRAM)
    long_ = durable(long_.join(_hashed(long_.select(F.substring("quote", 1, GRAM).alias("id")).distinct(), "id", None).withColumnRenamed("id", "head"), F.substring("quote", 1, GRAM) == F.col("head")).drop("head"), "heads")
    texts = segments.select(F.col("id").alias("segment_id"), "text")
    heads = long_.select("h").distinct()
    few = [r["h"] for r in heads.limit(FEW_QUOTES + 1).collect()]
    grams = _hashed(texts.select(F.col("segment_id").alias("id"), "text"), "text", np.array(few, np.int64) if len(few) <= FEW_QUOTES else None).withColumnRenamed("id", "segment_id")
    wanted = grams if len(few) <= FEW_QUOTES else grams.join(heads, "h", "left_semi")
    pairs = wanted.join(long_, "h").join(texts, "segment_id").where(F.contains("text", "quote")).select("segment_id", "entity_id", "name")
    # Quotes shorter than the gram cannot be hashed; they are few and meet on their first word.
    word = lambda c: F.explode(F.array_distinct(F.split(c, r"[^\p{L}\p{N}]+")))
    short = held.where(F.length("quote") < GRAM).withColumn("w", F.regexp_extract("quote", r"[\p{L}\p{N}]+", 0))
    tokens = texts.select("segment_id", word(F.col("text")).alias("w"))
    brief = tokens.join(short.where("w <> ''"), "w").join(texts, "segment_id").where(F.contains("text", "quote")).select("segment_id", "entity_id", "name")
    return pairs.unionByName(brief).distinct()


def _gram_hashes(text: str) -> np.ndarray:
    """Distinct hashes of all stretches of ``GRAM`` characters: differences of one running sum, each shifted to its start."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < GRAM:
        return np.zeros(0, np.int64)
    up = np.cumprod(np.r_[np.uint64(1), np.full(len(codes) - 1, _BASE)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(len(codes) - 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))])
    sums = np.r_[np.uint64(0), np.cumsum((codes + np.uint64(1)) * up)]
    hashed = (sums[GRAM:] - sums[:-GRAM]) * down[: len(codes) - GRAM + 1]
    return np.unique(hashed ^ (hashed >> np.uint64(31))).view(np.int64)


def _hashed(rows: DataFrame, column: str, among: np.ndarray | None) -> DataFrame:
    """``(id, h)``: the distinct hashes of ``column``, where given only those ``among`` the given ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column(column), strict=True):
                found = _gram_hashes(text.as_py() or "")
                if among is not None:
                    found = found[np.isin(found, among)]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([id_] * len(found), pa.string()), pa.array(found)], names=["id", "h"])

    return rows.mapInArrow(run, "id string, h long")


def extract_raw_relationships(segments: DataFrame, present: DataFrame, provider: Callable[[], Provider] = RuleProvider) -> DataFrame:
    """Provider answers for segments with the names of the entities present in each."""
    names = present.groupBy("segment_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    asked = segments.select(F.col("id").alias("segment_id"), "text").join(names, "segment_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for batch in batches:
            out = []
            for segment, text, known in zip(batch["segment_id"], batch["text"], batch["names"], strict=True):
                answer = model.generate_json(text or "", {"task": "relationships", "entities": list(known), "types": list(RELATIONS)})
                for place, r in enumerate(answer.get("relationships", [])):
                    out.append((segment, place, r.get("source"), r.get("target"), r.get("relation_type", r.get("type")), r.get("context"), r.get("bidirectional"), r.get("strength"), r.get("confidence")))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _RAW_RELATIONS.split(", ")])
            yield frame.astype({"bidirectional": "boolean", "strength": "Float64", "confidence": "Float64"})

    return asked.mapInPandas(run, _RAW_RELATIONS)


def resolve_names(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with names replaced by entity ids.

    Names match in lower case; of equal names the last entity wins; unmatched rows
    are dropped; missing type, direction, strength and confidence get defaults.
    """
    last = entities.groupBy(F.lower("name").alias("key")).agg(F.max_by("id", "ord").alias("entity"))
    out = raw
    for name, end in (("source_name", "source_entity"), ("target_name", "target_entity")):
        side = last.select(F.col("key").alias(f"__{end}"), F.col("entity").alias(end))
        out = out.join(side, F.lower(name) == F.col(f"__{end}")).drop(f"__{end}")
    ord_ = F.shiftleft(F.pmod(F.xxhash64("segment_id"), F.lit(1 << 42)), 20) + F.col("place")
    empty = F.create_map().cast("map<string,string>")
    return out.select(
        F.concat(F.lit("r:"), "segment_id", F.lit(":"), "place").alias("id"), "source_entity", "target_entity", F.coalesce("relation_type", F.lit("related_to")).alias("relation_type"), "context",
        empty.alias("attributes"), F.map_from_arrays(F.array(F.lit("segment_id")), F.array(F.col("segment_id"))).alias("metadata"), F.coalesce("bidirectional", F.lit(False)).alias("bidirectional"),
        F.coalesce("strength", F.lit(1.0)).alias("strength"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), ord_.alias("ord"),
    )


def extract_graph(segments: DataFrame, provider: Callable[[], Provider] = RuleProvider, name: str = "knowledge_graph") -> KG:
    """Segments to a graph: entities, merged by name and type, and the relationships between them."""
    raw = durable(extract_raw_entities(segments, provider), "raw-entities")
    entities = durable(deduplicate(entity_rows(raw, segments)), "entities")
    present = entities_in_segments(segments, entities)
    rels = resolve_names(durable(extract_raw_relationships(segments, present, provider), "raw-relationships"), entities)
    return KG(entities, durable(rels, "relationships"), name=name, unique=True)


def find_entity(entities: DataFrame, name: str) -> DataFrame:
    return entities.where(normalize_name(F.col("name")) == name.strip().lower())
