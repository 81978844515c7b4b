"""Graphs as JSON, JSON lines, GraphML and Cypher; readers and writers."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.operators.graph import KG
from graphwright.schema import ENTITIES, RELATIONSHIPS, entity_frame, plain_text, relationship_frame


def from_extraction(spark: SparkSession, data: dict, domain: str = "general") -> KG:
    """Graph of an extraction result ``{"entities": [...], "relationships": [...]}`` or a serialised graph."""
    if isinstance(data.get("entities"), dict):
        return from_dict(spark, data)
    entities = entity_frame(spark, list(data.get("entities", [])))
    return KG(entities, relationship_frame(spark, list(data.get("relationships", []))), name=f"{domain}_knowledge_graph")


def from_dict(spark: SparkSession, data: dict) -> KG:
    """Graph of its nested, id-keyed dictionary."""
    entities = [{"id": k, **v} for k, v in data.get("entities", {}).items()]
    rels = [{"id": k, **v} for k, v in data.get("relationships", {}).items()]
    return KG(entity_frame(spark, entities), relationship_frame(spark, rels), name=data.get("name", "knowledge_graph"), meta=dict(data.get("metadata", {})))


def from_registries(entities: DataFrame, relationships: DataFrame, name: str = "knowledge_graph", meta: dict[str, str] | None = None) -> KG:
    """Graph of two tables; relationships with unknown endpoints are dropped when it is read."""
    return KG(entities, relationships, name=name, meta=dict(meta or {}))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_json(spark: SparkSession, path: str) -> KG:
    """Graph of a folder that :func:`write_lines` wrote, or of nested JSON files; the name defaults to the path's last part.

    A nested file is parsed by an executor and its entries become rows there; only its name and metadata reach
    the driver.  A file without id-keyed dictionaries is an extraction result and is read as :func:`from_extraction` does.
    """
    if _exists(spark, f"{path}/entities"):
        return read_lines(spark, path)
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    head = text.select(F.schema_of_variant(F.try_variant_get("v", "$.entities", "variant")).startswith("OBJECT").alias("keyed"), F.try_variant_get("v", "$.name", "string").alias("name"),
                       F.try_variant_get("v", "$.metadata", "map<string,string>").alias("meta")).first()
    if head is None or not head["keyed"]:
        data = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return from_extraction(spark, {"name": PurePosixPath(path).stem, **data})

    def entries(name: str) -> DataFrame:
        found = F.try_variant_get("v", f"$.{name}", "map<string,variant>")
        rows = text.select(F.posexplode(F.coalesce(found, F.create_map().cast("map<string,variant>"))).alias("place", "id", "x"))
        get = lambda key, kind: F.try_variant_get("x", f"$.{key}", kind)
        plain = lambda key: F.coalesce(get(key, "map<string,string>"), F.create_map().cast("map<string,string>"))
        typed = F.coalesce(get("attributes", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
        shared = [
            F.coalesce(get("id", "string"), "id").alias("id"), get("context", "string").alias("context"), F.transform_values(typed, lambda _, x: F.to_json(x)).alias("attributes"),
            plain("metadata").alias("metadata"), F.coalesce(get("confidence", "double"), F.lit(1.0)).alias("confidence"), F.coalesce(get("ord", "bigint"), F.col("place").cast("bigint")).alias("ord"),
        ]
        if name == "entities":
            own = [get("name", "string").alias("name"), F.coalesce(get("entity_type", "string"), get("type", "string")).alias("entity_type")]
        else:
            own = [F.coalesce(get(f"{c}_entity", "string"), get(c, "string")).alias(f"{c}_entity") for c in ("source", "target")]
            own += [F.coalesce(get("relation_type", "string"), get("type", "string")).alias("relation_type"), F.coalesce(get("bidirectional", "boolean"), F.lit(False)).alias("bidirectional"), F.coalesce(get("strength", "double"), F.lit(1.0)).alias("strength")]
        order = [c.split()[0] for c in (ENTITIES if name == "entities" else RELATIONSHIPS).split(", ")]
        return rows.select(*own, *shared).select(*order)

    return KG(entries("entities"), entries("relationships"), name=head["name"] or PurePosixPath(path).stem, meta=dict(head["meta"] or {}))


def read_lines(spark: SparkSession, path: str) -> KG:
    """Graph of the JSON-lines tables that :func:`write_lines` wrote."""
    facts = spark.read.schema("name string, meta map<string,string>").json(f"{path}/graph").first() if _exists(spark, f"{path}/graph") else None
    tables = [spark.read.schema(shape).json(f"{path}/{name}") for name, shape in (("entities", ENTITIES), ("relationships", RELATIONSHIPS))]
    return KG(*tables, name=facts["name"] if facts else PurePosixPath(path).stem, meta=dict(facts["meta"] or {}) if facts else {})


def write_lines(kg: KG, path: str) -> None:
    """Tables of JSON lines, and the graph's name and metadata: the form for graphs of any size."""
    kg.nodes.write.mode("overwrite").json(f"{path}/entities")
    kg.rels.write.mode("overwrite").json(f"{path}/relationships")
    facts = kg.entities.sparkSession.createDataFrame([(kg.name, {k: str(v) for k, v in kg.meta.items()})], "name string, meta map<string,string>")
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/graph")


def to_dict(kg: KG, most: int = 100_000) -> dict:
    """The nested, id-keyed dictionary of a bounded graph; a larger one is an error."""
    nodes, rels = kg.nodes.orderBy("ord").limit(most + 1).collect(), kg.rels.orderBy("ord").limit(most + 1).collect()
    if max(len(nodes), len(rels)) > most:
        raise ValueError(f"more than {most} rows: write JSON lines instead")
    values = lambda m: {k: json.loads(v) for k, v in (m or {}).items()}

    def plain(row) -> dict:
        out = row.asDict()
        return {**out, "attributes": values(out["attributes"]), "metadata": dict(out["metadata"] or {})}

    return {
        "name": kg.name, "metadata": {**kg.meta, "entity_count": len(nodes), "relationship_count": len(rels)},
        "entities": {r["id"]: plain(r) for r in nodes}, "relationships": {r["id"]: plain(r) for r in rels},
    }


def to_json(kg: KG, most: int = 100_000) -> str:
    return json.dumps(to_dict(kg, most), ensure_ascii=False, indent=2)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))


def _cypher_value(value: Column) -> Column:
    """A property value: strings, lists and objects quoted, numbers and booleans bare."""
    bare = F.when(value == "true", "True").when(value == "false", "False").when(value == "null", "None").otherwise(value)
    return F.when(value.startswith('"'), _quoted(plain_text(value))).when(value.startswith("[") | value.startswith("{"), _quoted(value)).otherwise(bare)


def _properties(attributes: Column) -> Column:
    """Array of ``key: value`` texts by key."""
    return F.transform(F.array_sort(F.map_keys(attributes)), lambda k: F.concat(k, F.lit(": "), _cypher_value(F.element_at(attributes, k))))


def cypher_nodes(kg: KG) -> DataFrame:
    """``(ord, line)``: one CREATE statement per entity."""
    head = F.concat(F.lit("id: '"), "id", F.lit("', name: "), _quoted(F.col("name")), F.lit(", confidence: "), F.col("confidence").cast("string"))
    body = F.array_join(F.concat(F.array(head), _properties(F.col("attributes"))), ", ")
    return kg.nodes.select("ord", F.concat(F.lit("CREATE (e:"), F.replace("entity_type", F.lit("'"), F.lit("\\'")), F.lit(" {"), body, F.lit("})")).alias("line"))


def cypher_relationships(kg: KG) -> DataFrame:
    """``(ord, line)``: one MATCH ... CREATE statement per relationship."""
    kind = F.upper(F.replace(F.replace("relation_type", F.lit(" "), F.lit("_")), F.lit("'"), F.lit("\\'")))
    own = F.array(F.concat(F.lit("id: '"), "id", F.lit("'")), F.concat(F.lit("confidence: "), F.col("confidence").cast("string")), F.concat(F.lit("strength: "), F.col("strength").cast("string")))
    body = F.array_join(F.concat(_properties(F.col("attributes")), own), ", ")
    ends = F.concat(F.lit("MATCH (a:Entity {id: '"), "source_entity", F.lit("'}), (b:Entity {id: '"), "target_entity", F.lit("'}) "))
    return kg.rels.select("ord", F.concat(ends, F.lit("CREATE (a)-[r:"), kind, F.lit(" {"), body, F.lit("}]->(b)")).alias("line"))


def cypher_lines(kg: KG) -> DataFrame:
    """All statements ``(part, ord, line)``: constraint, entities, relationships."""
    spark = kg.entities.sparkSession
    constraint = spark.createDataFrame([(0, 0, "CREATE CONSTRAINT IF NOT EXISTS FOR (n:Entity) REQUIRE n.id IS UNIQUE;")], "part int, ord bigint, line string")
    return constraint.unionByName(cypher_nodes(kg).withColumn("part", F.lit(1))).unionByName(cypher_relationships(kg).withColumn("part", F.lit(2)))


def _xml(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def graphml_lines(kg: KG) -> DataFrame:
    """GraphML as ``(part, ord, line)`` with every column of the tables; attributes and metadata are JSON text, nulls have no element."""
    spark = kg.entities.sparkSession
    # Text is kept between bars, so that no reader trims it or takes it for a null.
    data = lambda key, c: F.coalesce(F.concat(F.lit(f'<data key="{key}">|'), _xml(c), F.lit("|</data>")), F.lit(""))
    shared = lambda: [data("context", F.col("context")), data("metadata", F.to_json("metadata")), data("ord", F.col("ord").cast("string"))]
    keys = [("label", "node"), ("entity_type", "node"), ("confidence", "all"), ("attributes", "all"), ("relation_type", "edge"), ("strength", "edge"), ("bidirectional", "edge"), ("context", "all"), ("metadata", "all"), ("ord", "all")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="{f}" attr.name="{k}" attr.type="string"/>' for k, f in keys] + ['<graph edgedefault="directed">']
    frame = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph></graphml>")], "part int, ord bigint, line string")
    nodes = kg.nodes.select(F.lit(1).alias("part"), "ord", F.concat(
        F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("label", F.col("name")), data("entity_type", F.col("entity_type")),
        data("confidence", F.col("confidence").cast("string")), data("attributes", F.to_json("attributes")), *shared(), F.lit("</node>")).alias("line"))
    rels = kg.rels.select(F.lit(2).alias("part"), "ord", F.concat(
        F.lit('<edge id="'), _xml(F.col("id")), F.lit('" source="'), _xml(F.col("source_entity")), F.lit('" target="'), _xml(F.col("target_entity")), F.lit('">'),
        data("relation_type", F.col("relation_type")), data("confidence", F.col("confidence").cast("string")), data("strength", F.col("strength").cast("string")),
        data("attributes", F.to_json("attributes")), data("bidirectional", F.col("bidirectional").cast("string")), *shared(), F.lit("</edge>")).alias("line"))
    return frame.unionByName(nodes).unionByName(rels)


def read_graphml(spark: SparkSession, path: str) -> KG:
    """Graph of a GraphML file as :func:`graphml_lines` renders it."""
    data = "data ARRAY<STRUCT<_key: STRING, _VALUE: STRING>>"
    # Part files are pieces of one document; the newer parser takes each for a whole one and stops at the end of its first element.
    source = lambda tag: spark.read.format("xml").option("rowTag", tag).option("nullValue", "\u0000").option("useLegacyXMLParser", "true")
    nodes = source("node").schema(f"_id STRING, {data}").load(path)
    edges = source("edge").schema(f"_id STRING, _source STRING, _target STRING, {data}").load(path)


    def field(key: str) -> Column:
        value = F.get(F.filter("data", lambda d: d["_key"] == key), F.lit(0))["_VALUE"]
        # Files of other writers have no bars.
        return F.when(value.rlike(r"(?s)^\|.*\|$"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)

    empty = F.create_map().cast("map<string,string>")
    attributes, metadata = (F.coalesce(F.from_json(field(c), "map<string,string>"), empty) for c in ("attributes", "metadata"))
    ord_ = F.coalesce(field("ord").cast("bigint"), F.monotonically_increasing_id())
    entities = nodes.where("_id is not null").select(
        F.col("_id").alias("id"), field("label").alias("name"), field("entity_type").alias("entity_type"), field("context").alias("context"), attributes.alias("attributes"),
        metadata.alias("metadata"), field("confidence").cast("double").alias("confidence"), ord_.alias("ord"),
    )
    rels = edges.where("_id is not null").select(
        F.col("_id").alias("id"), F.col("_source").alias("source_entity"), F.col("_target").alias("target_entity"), field("relation_type").alias("relation_type"), field("context").alias("context"),
        attributes.alias("attributes"), metadata.alias("metadata"), F.coalesce(field("bidirectional").cast("boolean"), F.lit(False)).alias("bidirectional"), field("strength").cast("double").alias("strength"),
        field("confidence").cast("double").alias("confidence"), ord_.alias("ord"),
    )
    return KG(entities, rels, name=PurePosixPath(path).stem)


def export(kg: KG, path: str, format: str) -> None:
    """Write a graph as ``json`` (JSON lines), ``graphml`` or ``cypher``; other formats are an error.

    Text formats are written in order as part files of one directory.
    """
    if format == "json":
        return write_lines(kg, path)
    lines = {"graphml": graphml_lines, "cypher": cypher_lines}.get(format)
    if lines is None:
        raise ValueError(f"unknown format {format!r}; known: json, graphml, cypher")
    lines(kg).orderBy("part", "ord").select("line").write.mode("overwrite").text(path)


def import_graph(spark: SparkSession, path: str, format: str) -> KG:
    """Read a graph that :func:`export` wrote, or a nested JSON file."""
    readers = {"json": read_json, "jsonl": read_lines, "graphml": read_graphml}
    if format not in readers:
        raise ValueError(f"unknown format {format!r}; known: {sorted(readers)}")
    return readers[format](spark, path)
