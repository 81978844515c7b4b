"""A property graph over the relational tables, defined by SQL that Spark and DuckDB share.

The two texts below are the single definition: queries read them through Spark,
their oracles through DuckDB.  Spark gets two join conditions in a form with a key (``KEYED``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.operators.graph import KG, with_endpoints
from graphwright.plans.durable import durable
from graphwright.schema import relationship_frame

TABLES = ("region", "nation", "customer", "supplier", "part", "lineitem", "events")

#: Entities with attribute columns as JSON text; ``ord`` is a number built from kind and key.
ENTITIES_SQL = """
SELECT 'r' || r_regionkey AS id, r_name AS name, 'Region' AS entity_type, CAST(NULL AS VARCHAR(99)) AS context, CAST(1.0 AS DOUBLE) AS confidence,
  CAST(r_regionkey AS BIGINT) AS ord, CAST(NULL AS VARCHAR(99)) AS a_brand, CAST(NULL AS VARCHAR(99)) AS a_kind, CAST(NULL AS VARCHAR(99)) AS a_size, CAST(NULL AS VARCHAR(99)) AS a_segment FROM {region}
UNION ALL SELECT 'n' || n_nationkey, n_name, 'Nation', 'region ' || n_regionkey, CAST(0.9 AS DOUBLE) + CAST(n_nationkey % 10 AS DOUBLE) / 100,
  1000000000000 + n_nationkey, NULL, NULL, NULL, NULL FROM {nation}
UNION ALL SELECT 'c' || c_custkey, c_name, 'Customer', 'segment ' || c_mktsegment, CAST(0.5 AS DOUBLE) + CAST(c_custkey % 50 AS DOUBLE) / 100,
  2000000000000 + c_custkey, NULL, NULL, NULL, '"' || c_mktsegment || '"' FROM {customer}
UNION ALL SELECT 's' || s_suppkey, s_name, 'Supplier', NULL, CAST(0.5 AS DOUBLE) + CAST(s_suppkey % 50 AS DOUBLE) / 100,
  3000000000000 + s_suppkey, NULL, NULL, NULL, NULL FROM {supplier}
UNION ALL SELECT 'p' || p_partkey, p_name, 'Part', p_type || ' of ' || p_brand, CAST(0.5 AS DOUBLE) + CAST(p_partkey % 50 AS DOUBLE) / 100,
  4000000000000 + p_partkey, '"' || p_brand || '"', '"' || p_type || '"', CAST(p_size AS VARCHAR(99)), NULL FROM {part}
UNION ALL SELECT 'k' || p_type, p_type, 'Skill', NULL, CAST(0.9 AS DOUBLE), 5000000000000 + min(p_partkey), NULL, NULL, NULL, NULL FROM {part} GROUP BY p_type
UNION ALL SELECT 'b' || p_brand, p_brand, 'Job', NULL, CAST(0.9 AS DOUBLE), 6000000000000 + min(p_partkey), NULL, NULL, NULL, NULL FROM {part} GROUP BY p_brand
"""

#: Relationships; those to absent ids are kept in this raw list.
RELATIONSHIPS_SQL = """
SELECT 'cn' || c_custkey AS id, 'c' || c_custkey AS source_entity, 'n' || c_nationkey AS target_entity, 'part-of' AS relation_type,
  false AS bidirectional, CAST(0.8 AS DOUBLE) AS strength, CAST(0.7 AS DOUBLE) + CAST(c_custkey % 30 AS DOUBLE) / 100 AS confidence, CAST(c_custkey AS BIGINT) AS ord FROM {customer}
UNION ALL SELECT 'sn' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey, 'part_of', false, CAST(0.9 AS DOUBLE), CAST(0.6 AS DOUBLE) + CAST(s_suppkey % 40 AS DOUBLE) / 100, 1000000000000 + s_suppkey FROM {supplier}
UNION ALL SELECT 'nr' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey, 'part-of', false, CAST(1.0 AS DOUBLE), CAST(0.95 AS DOUBLE), 2000000000000 + n_nationkey FROM {nation}
UNION ALL SELECT 'rn' || n_nationkey, 'r' || n_regionkey, 'n' || n_nationkey, 'contains', false, CAST(1.0 AS DOUBLE), CAST(0.9 AS DOUBLE), 3000000000000 + n_nationkey FROM {nation} WHERE n_nationkey % 2 = 0
UNION ALL SELECT DISTINCT 'sp' || l_suppkey || '_' || l_partkey, 's' || l_suppkey, 'p' || l_partkey, 'supplies', false, CAST(0.5 AS DOUBLE),
  CAST(0.5 AS DOUBLE) + CAST((l_suppkey + l_partkey) % 50 AS DOUBLE) / 100, 4000000000000 + l_suppkey * 10000000 + l_partkey FROM {lineitem} WHERE l_quantity >= 49
UNION ALL SELECT 'ss' || a.s_suppkey, 's' || a.s_suppkey, 's' || b.s_suppkey, 'similar-to', a.s_suppkey % 5 = 0, CAST(0.7 AS DOUBLE),
  CAST(0.6 AS DOUBLE) + CAST(a.s_suppkey % 40 AS DOUBLE) / 100, 6000000000000000 + a.s_suppkey FROM {supplier} a JOIN {supplier} b ON b.s_suppkey = a.s_suppkey + 1
UNION ALL SELECT 'sr' || a.s_suppkey, 's' || b.s_suppkey, 's' || a.s_suppkey, 'similar-to', false, CAST(0.7 AS DOUBLE), CAST(0.8 AS DOUBLE), 7000000000000000 + a.s_suppkey
  FROM {supplier} a JOIN {supplier} b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_suppkey % 3 = 0
UNION ALL SELECT DISTINCT 'sk' || l_suppkey || '_' || p_type, 's' || l_suppkey, 'k' || p_type, 'has-skill', false, CAST(0.6 AS DOUBLE),
  CAST(0.8 AS DOUBLE) + CAST(l_suppkey % 20 AS DOUBLE) / 100, 8000000000000000 + l_suppkey FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_quantity >= 50 AND l_linenumber = 1
UNION ALL SELECT 'kb' || p_type || '_' || p_brand, 'k' || p_type, 'b' || p_brand, 'required_for', false, CAST(0.6 AS DOUBLE),
  CAST(0.8 AS DOUBLE) + CAST(min(p_partkey) % 20 AS DOUBLE) / 100, 9000000000000000 + min(p_partkey) FROM {part} WHERE p_partkey % 10 = 0 GROUP BY p_type, p_brand
UNION ALL SELECT 'pc' || a.p_partkey, 'p' || a.p_partkey, 'p' || b.p_partkey, 'causes', false, CAST(0.5 AS DOUBLE), CAST(0.6 AS DOUBLE) + CAST(a.p_partkey % 4 AS DOUBLE) / 10, 10000000000000000 + a.p_partkey
  FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 7 = 0
UNION ALL SELECT 'pv' || a.p_partkey, 'p' || a.p_partkey, 'p' || b.p_partkey, 'prevents', false, CAST(0.5 AS DOUBLE), CAST(0.75 AS DOUBLE), 11000000000000000 + a.p_partkey
  FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 14 = 0
UNION ALL SELECT 'pi' || a.p_partkey || '_' || b.p_partkey, 'p' || a.p_partkey, 'p' || b.p_partkey, 'is-a', false, CAST(0.5 AS DOUBLE),
  CAST(0.6 AS DOUBLE) + CAST(b.p_partkey % 3 AS DOUBLE) / 10, 12000000000000000 + a.p_partkey
  FROM {part} a JOIN {part} b ON (a.p_partkey % 30 IN (0, 1) AND b.p_partkey = a.p_partkey + 1) OR (a.p_partkey % 30 = 2 AND b.p_partkey = a.p_partkey - 2)
UNION ALL SELECT 'pn' || a.p_partkey, 'p' || a.p_partkey, 'p' || b.p_partkey, 'is-not-a', false, CAST(0.5 AS DOUBLE), CAST(0.55 AS DOUBLE), 13000000000000000 + a.p_partkey
  FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 2 WHERE a.p_partkey % 60 = 0
UNION ALL SELECT 'pl' || a.p_partkey, 'p' || a.p_partkey, 'p' || b.p_partkey, 'subclass-of', false, CAST(0.5 AS DOUBLE), CAST(0.8 AS DOUBLE), 15000000000000000 + a.p_partkey
  FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 30 BETWEEN 10 AND 17
UNION ALL SELECT 'pd' || a.p_partkey, 'p' || a.p_partkey, 'p' || b.p_partkey, 'separate-from', false, CAST(0.5 AS DOUBLE), CAST(0.7 AS DOUBLE), 16000000000000000 + a.p_partkey
  FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 8 WHERE a.p_partkey % 30 = 10
UNION ALL SELECT 'p5' || a.p_partkey || '_' || b.p_partkey, 'p' || a.p_partkey, 'p' || b.p_partkey, 'contains', false, CAST(0.5 AS DOUBLE),
  CAST(0.6 AS DOUBLE) + CAST(a.p_partkey % 5 AS DOUBLE) / 10, 17000000000000000 + a.p_partkey
  FROM {part} a JOIN {part} b ON (a.p_partkey % 30 BETWEEN 20 AND 23 AND b.p_partkey = a.p_partkey + 1) OR (a.p_partkey % 30 = 24 AND b.p_partkey = a.p_partkey - 4)
UNION ALL SELECT 'px' || p_partkey, 'p' || p_partkey, 'x' || p_partkey, 'related-to', false, CAST(0.5 AS DOUBLE), CAST(0.9 AS DOUBLE), 14000000000000000 + p_partkey FROM {part} WHERE p_partkey % 101 = 0
"""

#: Join conditions in which Spark finds no key, so that it would compare every row with every row, and the same condition with
#: a key: the remainders exclude each other, so each row ``a`` has one partner at most.
KEYED = {
    "(a.p_partkey % 30 IN (0, 1) AND b.p_partkey = a.p_partkey + 1) OR (a.p_partkey % 30 = 2 AND b.p_partkey = a.p_partkey - 2)":
        "b.p_partkey = a.p_partkey + CASE WHEN a.p_partkey % 30 IN (0, 1) THEN 1 WHEN a.p_partkey % 30 = 2 THEN -2 END",
    "(a.p_partkey % 30 BETWEEN 20 AND 23 AND b.p_partkey = a.p_partkey + 1) OR (a.p_partkey % 30 = 24 AND b.p_partkey = a.p_partkey - 4)":
        "b.p_partkey = a.p_partkey + CASE WHEN a.p_partkey % 30 BETWEEN 20 AND 23 THEN 1 WHEN a.p_partkey % 30 = 24 THEN -4 END",
}


def keyed(sql: str) -> str:
    """``sql`` with the conditions of ``KEYED`` in their form with a key."""
    for condition, key in KEYED.items():
        sql = sql.replace(condition, key)
    return sql


def _frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


#: The graph's tables by application, folder and table: each built when first asked for, then read like any stored graph.
_LOADED: dict[tuple[str, str, str], DataFrame] = {}


def _table(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LOADED:
        _LOADED[key] = durable(build(spark, sf_dir), name)
    return _LOADED[key]


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "entities", _build_entities)


def raw_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relationships, those to absent ids included."""
    return _table(spark, sf_dir, "relationships", _build_relationships)


def _build_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(ENTITIES_SQL, **{k: v for k, v in _frames(spark, sf_dir).items() if f"{{{k}}}" in ENTITIES_SQL})
    parts = [F.struct(F.lit(k).alias("key"), F.col(f"a_{k}").alias("value")) for k in ("brand", "kind", "segment", "size")]
    attributes = F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"].isNotNull()))
    return rows.select("id", "name", "entity_type", "context", attributes.alias("attributes"), F.create_map().cast("map<string,string>").alias("metadata"), "confidence", "ord")


def _build_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(keyed(RELATIONSHIPS_SQL), **{k: v for k, v in _frames(spark, sf_dir).items() if f"{{{k}}}" in RELATIONSHIPS_SQL})
    empty = F.create_map().cast("map<string,string>")
    return rows.select(
        "id", "source_entity", "target_entity", "relation_type", F.concat(F.col("relation_type"), F.lit(" by rule")).alias("context"), empty.alias("attributes"),
        empty.alias("metadata"), "bidirectional", "strength", "confidence", "ord",
    )


def test_graph(spark: SparkSession, sf_dir: str, types: list[str] | None = None, entity_types: list[str] | None = None) -> KG:
    """The graph, or the part of it with the given relationship and entity types."""
    nodes, rels = raw_entities(spark, sf_dir), raw_relationships(spark, sf_dir)
    if types:
        rels = rels.where(F.col("relation_type").isin(types))
    if entity_types:
        nodes = nodes.where(F.col("entity_type").isin(entity_types))
    # Ids are distinct by construction; only relationships to absent ids have to go.
    kg = KG(nodes, rels, name="test_graph", unique=True)
    return replace(kg, relationships=with_endpoints(rels, nodes))


def entity_graph(spark: SparkSession, sf_dir: str) -> KG:
    """All entities without their relationships, for operators that read none."""
    return KG(raw_entities(spark, sf_dir), relationship_frame(spark, []), name="test_graph", unique=True)


def oracle(body: str, types: list[str] | None = None, entity_types: list[str] | None = None) -> str:
    """DuckDB SQL of ``body`` over the tables ``ent``, ``raw`` (all relationships) and ``rel`` (known endpoints)."""

    def plain(text: str) -> str:
        for t in TABLES:
            text = text.replace(f"{{{t}}}", t)
        return text

    among = lambda c, values: f" WHERE {c} IN ({', '.join(repr(v) for v in values)})" if values else ""
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    return f"""WITH {recursive}ent AS (SELECT * FROM ({plain(ENTITIES_SQL)}){among("entity_type", entity_types)}),
raw AS (SELECT * FROM ({plain(RELATIONSHIPS_SQL)}){among("relation_type", types)}),
rel AS (SELECT * FROM raw WHERE source_entity IN (SELECT id FROM ent) AND target_entity IN (SELECT id FROM ent)),
typed AS (SELECT *, replace(replace(lower(relation_type), '_', '-'), ' ', '-') AS kind FROM rel),
written AS (SELECT id, source_entity AS s, target_entity AS t, relation_type, confidence, ord, 0 AS back FROM rel
  UNION ALL SELECT id || '_reverse', target_entity, source_entity, relation_type, confidence, ord, 1 FROM rel WHERE bidirectional),
edges AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY ord DESC, back DESC) AS n FROM written) WHERE n = 1)
{body.replace("RECURSIVE", "")}"""
