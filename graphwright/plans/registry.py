"""Registered graph and text queries, each beside its DuckDB SQL.

Every query runs over its whole tables.  Graph queries use the graph of
``graphwright.plans.testgraph``; ``limit`` appears only where it is the feature
(top-k reports, the first paths).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import language, text
from graphwright.operators import conflicts, coref, extract, metrics, query, reason, registry, segment, summarize, traverse, verify, viz
from graphwright.operators.graph import KG, reverse
from graphwright.plans.durable import shared_dir
from graphwright.plans.spread import spread
from graphwright.plans.testgraph import entity_graph, oracle, raw_entities, raw_relationships, test_graph
from graphwright.schema import entity_frame, validate_entities, validate_relationships
from graphwright.sources import graph_io
from graphwright.sources.store import GraphStore
from graphwright.streaming import upsert

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: Relation types whose edges all-pairs queries follow (all entities take part).
_PLACES = ["part-of", "part_of", "contains"]


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return put


def _graph(name: str, build: Callable[[KG], DataFrame], body: str | None, types: list[str] | None = None, entity_types: list[str] | None = None) -> None:
    """A query over the graph (or its part) and the SQL body over the oracle's tables."""
    _add(name, oracle(body, types, entity_types) if body else None)(lambda spark, sf_dir: build(test_graph(spark, sf_dir, types, entity_types)))


def _entities(name: str, build: Callable[[KG], DataFrame], body: str | None) -> None:
    """As :func:`_graph`, for a query that reads no relationship: they are not built for it."""
    _add(name, oracle(body) if body else None)(lambda spark, sf_dir: build(entity_graph(spark, sf_dir)))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _r(c: str, alias: str | None = None) -> F.Column:
    return F.round(c, 6).alias(alias or c)


_REL = ["id", "source_entity", "target_entity", "relation_type"]

# --- predicate search -------------------------------------------------------------------------------------------------

_graph("find_entities_type", lambda g: query.find_entities(g, {"type": "Part"}).select("id", "name", _r("confidence")), "SELECT id, name, round(confidence, 6) AS confidence FROM ent WHERE entity_type = 'Part'")
_graph("find_entities_name_exact", lambda g: query.find_entities(g, {"name": "ASIA"}).select("id", "name"), "SELECT id, name FROM ent WHERE name = 'ASIA'")
_graph("find_entities_name_contains", lambda g: query.find_entities(g, {"name": {"contains": "00"}}).select("id", "name"), "SELECT id, name FROM ent WHERE contains(name, '00')")
_graph("find_entities_name_regex", lambda g: query.find_entities(g, {"name": {"regex": "[0-9]*7$"}, "type": "Customer"}).select("id", "name"), "SELECT id, name FROM ent WHERE regexp_matches(name, '[0-9]*7$') AND entity_type = 'Customer'")
_graph("find_entities_conf_range", lambda g: query.find_entities(g, {"confidence": {"min": 0.6, "max": 0.8}}).select("id", _r("confidence")), "SELECT id, round(confidence, 6) AS confidence FROM ent WHERE confidence >= 0.6::DOUBLE AND confidence <= 0.8::DOUBLE")
_graph("find_entities_attr", lambda g: query.find_entities(g, {"attributes": {"size": 10}}).select("id", "name"), "SELECT id, name FROM ent WHERE a_size = '10'")
_graph("find_entities_unknown_key", lambda g: query.find_entities(g, {"size": 10}).select("id", "entity_type"), "SELECT id, entity_type FROM ent WHERE a_size IS NULL OR a_size = '10'")
_graph("find_entities_first", lambda g: query.find_entities(g, {"type": "Supplier"}, limit=5).select("id", "ord"), "SELECT id, ord FROM ent WHERE entity_type = 'Supplier' ORDER BY ord LIMIT 5")
_graph("find_relationships_type", lambda g: query.find_relationships(g, {"type": "part-of"}).select(*_REL), "SELECT id, source_entity, target_entity, relation_type FROM rel WHERE relation_type = 'part-of'")
_graph("find_relationships_strength", lambda g: query.find_relationships(g, {"strength": {"min": 0.7, "max": 0.95}, "confidence": {"min": 0.9}}).select("id", _r("strength"), _r("confidence")), "SELECT id, round(strength, 6) AS strength, round(confidence, 6) AS confidence FROM rel WHERE strength >= 0.7::DOUBLE AND strength <= 0.95::DOUBLE AND confidence >= 0.9::DOUBLE")
_graph("find_relationships_bidirectional", lambda g: query.find_relationships(g, {"bidirectional": True, "type": "similar-to"}).select(*_REL), "SELECT id, source_entity, target_entity, relation_type FROM rel WHERE bidirectional AND relation_type = 'similar-to'")
_graph("search_text_ci", lambda g: query.search_text(g, "brand#1[0-9]")[0].select("id", "entity_type"), "SELECT id, entity_type FROM ent WHERE regexp_matches(name, '(?i)brand#1[0-9]') OR regexp_matches(context, '(?i)brand#1[0-9]') OR regexp_matches(a_brand, '(?i)brand#1[0-9]') OR regexp_matches(a_kind, '(?i)brand#1[0-9]') OR regexp_matches(a_segment, '(?i)brand#1[0-9]')")
_graph("search_text_cs", lambda g: query.search_text(g, "AUTO|Region", case_sensitive=True)[0].select("id", "entity_type"), "SELECT id, entity_type FROM ent WHERE regexp_matches(name, 'AUTO|Region') OR regexp_matches(context, 'AUTO|Region') OR regexp_matches(a_brand, 'AUTO|Region') OR regexp_matches(a_kind, 'AUTO|Region') OR regexp_matches(a_segment, 'AUTO|Region')")
_graph("search_text_relationships", lambda g: query.search_text(g, "^SIMILAR", search_in=["context"])[1].select("id"), "SELECT id FROM rel WHERE regexp_matches(relation_type || ' by rule', '(?i)^SIMILAR')")
_graph("search_text_type", lambda g: query.search_text(g, "1", ["name"], ["Supplier", "Nation"])[0].select("id", "name"), "SELECT id, name FROM ent WHERE regexp_matches(name, '1') AND entity_type IN ('Supplier', 'Nation')")

# --- subgraphs and filters --------------------------------------------------------------------------------------------

_SEEDS = ["s1", "s2", "n1", "n2", "r0", "r1", "p30", "p31"]
_SEED_SQL = ", ".join(f"'{x}'" for x in _SEEDS)
_graph("subgraph_induced", lambda g: query.subgraph(g, _SEEDS, max_relationships=None).rels.select(*_REL), f"SELECT id, source_entity, target_entity, relation_type FROM rel WHERE source_entity IN ({_SEED_SQL}) AND target_entity IN ({_SEED_SQL})")
_NEAR = f"SELECT id FROM ent WHERE id IN ({_SEED_SQL}) UNION SELECT target_entity FROM rel WHERE source_entity IN ({_SEED_SQL}) UNION SELECT source_entity FROM rel WHERE target_entity IN ({_SEED_SQL})"
_graph("subgraph_neighbors", lambda g: query.subgraph(g, _SEEDS, True, None).rels.select(*_REL), f", near AS ({_NEAR}) SELECT id, source_entity, target_entity, relation_type FROM rel WHERE source_entity IN (SELECT id FROM near) AND target_entity IN (SELECT id FROM near)")
_graph("subgraph_neighbor_entities", lambda g: query.subgraph(g, _SEEDS, True).nodes.select("id", "name"), f", near AS ({_NEAR}) SELECT id, name FROM ent WHERE id IN (SELECT id FROM near)")
_graph("subgraph_first_relationships", lambda g: query.subgraph(g, _SEEDS, True, 20).rels.select("id", "ord"), f", near AS ({_NEAR}) SELECT id, ord FROM rel WHERE source_entity IN (SELECT id FROM near) AND target_entity IN (SELECT id FROM near) ORDER BY ord LIMIT 20", types=["part-of", "contains", "similar-to", "is-a"])
_graph("filter_conf_entities", lambda g: query.filter_by_confidence(g, 0.8, "entities").rels.select("id"), "SELECT id FROM rel WHERE source_entity IN (SELECT id FROM ent WHERE confidence >= 0.8::DOUBLE) AND target_entity IN (SELECT id FROM ent WHERE confidence >= 0.8::DOUBLE)")
_graph("filter_conf_rels", lambda g: query.filter_by_confidence(g, 0.8, "relationships").rels.select("id"), "SELECT id FROM rel WHERE confidence >= 0.8::DOUBLE")
_graph("filter_conf_both", lambda g: query.filter_by_confidence(g, 0.8).rels.select("id"), "SELECT id FROM rel WHERE confidence >= 0.8::DOUBLE AND source_entity IN (SELECT id FROM ent WHERE confidence >= 0.8::DOUBLE) AND target_entity IN (SELECT id FROM ent WHERE confidence >= 0.8::DOUBLE)")
_graph("filter_conf_both_entities", lambda g: query.filter_by_confidence(g, 0.8).nodes.select("id"), "SELECT id FROM ent WHERE confidence >= 0.8::DOUBLE")
_graph("entity_relationships", lambda g: g.entity_relationships("n3").select(*_REL), "SELECT id, source_entity, target_entity, relation_type FROM rel WHERE source_entity = 'n3' OR target_entity = 'n3'")
_graph("outgoing_relationships", lambda g: g.outgoing("s3", ["supplies", "similar-to"]).select(*_REL), "SELECT id, source_entity, target_entity, relation_type FROM rel WHERE source_entity = 's3' AND relation_type IN ('supplies', 'similar-to')")
_graph("incoming_relationships", lambda g: g.incoming("n4", ["part_of"]).select(*_REL), "SELECT id, source_entity, target_entity, relation_type FROM rel WHERE target_entity = 'n4' AND relation_type = 'part_of'")
_graph("rels_between", lambda g: g.relationships_between("p14", "p15").select(*_REL), "SELECT id, source_entity, target_entity, relation_type FROM rel WHERE source_entity = 'p14' AND target_entity = 'p15'")
_graph("entity_by_id", lambda g: g.entity("n7").select("id", "name", "entity_type"), "SELECT id, name, entity_type FROM ent WHERE id = 'n7'")
_graph("relationship_by_id", lambda g: g.relationship("cn7").select(*_REL), "SELECT id, source_entity, target_entity, relation_type FROM rel WHERE id = 'cn7'")
_graph("entities_by_type", lambda g: g.entities_by_type("Nation").select("id", "name"), "SELECT id, name FROM ent WHERE entity_type = 'Nation'")
_graph("relationships_by_type", lambda g: g.relationships_by_type("causes").select(*_REL), "SELECT id, source_entity, target_entity, relation_type FROM rel WHERE relation_type = 'causes'")
_graph("registry_find_by_name", lambda g: registry.find_by_name(g.nodes, " asia ").select("id", "name"), "SELECT id, name FROM ent WHERE trim(lower(name)) = 'asia'")
_graph("registry_find_relationships", lambda g: registry.find_relationships(g.rels, entity="p30", relation_type="is-a").select(*_REL), "SELECT id, source_entity, target_entity, relation_type FROM rel WHERE (source_entity = 'p30' OR target_entity = 'p30') AND relation_type = 'is-a'")

# --- metrics ----------------------------------------------------------------------------------------------------------

_graph("type_counts", metrics.type_counts, "SELECT entity_type, count(*) AS entities FROM ent GROUP BY 1")
_graph("rel_type_counts", metrics.relation_type_counts, "SELECT relation_type, count(*) AS relationships FROM rel GROUP BY 1")
_graph("edge_collapse", lambda g: g.edges.select("id", "s", "t", "reverse"), "SELECT id, s, t, back = 1 AS reverse FROM edges")
_ENDS = ", ends AS (SELECT s AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT t, 1, 0 FROM edges)"
_graph("degree_centrality", lambda g: metrics.degree_centrality(g).select("id", _r("score")), f"{_ENDS}, d AS (SELECT id, sum(i + o) AS d FROM ends GROUP BY 1) SELECT ent.id, round(coalesce(d, 0) / ((SELECT count(*) FROM ent) - 1), 6) AS score FROM ent LEFT JOIN d ON ent.id = d.id")
_graph("topk_degree", lambda g: metrics.sort_by_metric(g, "degree", 10).select("id", _r("score")), f"{_ENDS}, d AS (SELECT id, sum(i + o) AS d FROM ends GROUP BY 1) SELECT ent.id, round(coalesce(d, 0) / ((SELECT count(*) FROM ent) - 1), 6) AS score FROM ent LEFT JOIN d ON ent.id = d.id ORDER BY coalesce(d, 0) DESC, ord LIMIT 10")
_graph("topk_by_expression", lambda g: metrics.sort_by_metric(g, F.length("name") * F.col("confidence"), 10).select("id", _r("score")), "SELECT id, round(length(name) * confidence, 6) AS score FROM ent ORDER BY length(name) * confidence DESC, ord LIMIT 10")
_CLUSTER = """, pair AS (SELECT least(s, t) AS a, greatest(s, t) AS b, count(*) AS w FROM edges WHERE s <> t GROUP BY 1, 2),
way AS (SELECT a AS u, b AS v, w FROM pair UNION ALL SELECT b, a, w FROM pair),
d AS (SELECT u, sum(w) AS d, count(*) FILTER (w = 2) AS m FROM way GROUP BY 1),
tri AS (SELECT x.u, sum(x.w * y.w * z.w) / 2 AS t FROM way x JOIN way y ON x.v = y.u JOIN way z ON y.v = z.u AND z.v = x.u GROUP BY 1),
score AS (SELECT ent.id, CASE WHEN tri.t IS NULL THEN 0 ELSE tri.t / (d.d * (d.d - 1) - 2 * m) END AS score FROM ent LEFT JOIN d ON ent.id = d.u LEFT JOIN tri ON ent.id = tri.u)"""
_graph("clustering", lambda g: metrics.clustering(g).select("id", _r("score")), f"{_CLUSTER} SELECT id, round(score, 6) AS score FROM score")
_LABELS = """RECURSIVE, lab(id, label) AS (SELECT id, id FROM ent UNION SELECT n.id, lab.label FROM lab JOIN
  (SELECT s AS o, t AS id FROM edges UNION SELECT t, s FROM edges) n ON n.o = lab.id),
comp AS (SELECT id, min(label) AS component FROM lab GROUP BY 1)"""
_LINKS = ["similar-to", "causes", "is-a", "prevents"]
_graph("components", metrics.components, f"{_LABELS} SELECT id, component FROM comp", types=_LINKS)
# The whole graph is dense: labels are kept by key, so that the recursion holds one row an entity.
_LEAST = """RECURSIVE, near AS (SELECT s AS o, t AS id FROM edges UNION SELECT t, s FROM edges),
lab(id, label) USING KEY (id) AS (SELECT id, id FROM ent UNION SELECT near.id, min(lab.label) FROM lab JOIN near ON near.o = lab.id JOIN recurring.lab old ON old.id = near.id WHERE lab.label < old.label GROUP BY near.id),
comp AS (SELECT id, label AS component FROM lab)"""
_graph("components_all", metrics.components, f"{_LEAST} SELECT id, component FROM comp")
_STATS = "SELECT (SELECT count(*) FROM ent) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM rel) AS relationships, round((SELECT count(*) FROM edges) / ((SELECT count(*) FROM ent) * ((SELECT count(*) FROM ent) - 1)), 6) AS density, (SELECT count(DISTINCT component) FROM comp) = 1 AS connected, (SELECT count(DISTINCT component) FROM comp) AS components, round((SELECT avg(score) FROM score), 6) AS average_clustering"
_graph("graph_stats_all", lambda g: metrics.stats(g).select("nodes", "edges", "relationships", _r("density"), "connected", "components", _r("average_clustering")), f"{_LEAST}{_CLUSTER} {_STATS}")
_graph("graph_stats", lambda g: metrics.stats(g).select("nodes", "edges", "relationships", _r("density"), "connected", "components", _r("average_clustering")),
       f"{_LABELS}{_CLUSTER} {_STATS}", types=_LINKS)


def _pagerank_sql(rounds: int) -> str:
    out = ", k AS (SELECT s, count(*) AS k FROM edges GROUP BY 1), n AS (SELECT count(*) AS n FROM ent), p0 AS (SELECT id, 1.0::DOUBLE / n AS score FROM ent, n)"
    for i in range(1, rounds + 1):
        out += f""", g{i} AS (SELECT t, sum(score / k) AS got FROM p{i - 1} p JOIN edges ON p.id = edges.s JOIN k ON k.s = edges.s GROUP BY 1),
l{i} AS (SELECT coalesce(sum(score), 0) AS lost FROM p{i - 1} WHERE id NOT IN (SELECT s FROM k)),
p{i} AS (SELECT ent.id, 0.85::DOUBLE * coalesce(got, 0) + 0.85::DOUBLE * lost / n + 0.15::DOUBLE / n AS score FROM ent LEFT JOIN g{i} ON ent.id = t, n, l{i})"""
    return out + f" SELECT id, round(score, 6) AS score FROM p{rounds}"


def _eigenvector_sql(rounds: int) -> str:
    out = ", p0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ent) AS score FROM ent)"
    for i in range(1, rounds + 1):
        out += f""", g{i} AS (SELECT t, sum(score) AS got FROM p{i - 1} p JOIN edges ON p.id = edges.s GROUP BY 1),
u{i} AS (SELECT p.id, score + coalesce(got, 0) AS score FROM p{i - 1} p LEFT JOIN g{i} ON p.id = t), p{i} AS (SELECT id, score / (SELECT sqrt(sum(score * score)) FROM u{i}) AS score FROM u{i})"""
    return out + f" SELECT id, round(score, 6) AS score FROM p{rounds}"


_graph("pagerank_fixed", lambda g: metrics.pagerank(g, rounds=5, tolerance=None).select("id", _r("score")), _pagerank_sql(5))
_graph("eigenvector_fixed", lambda g: metrics.eigenvector(g, rounds=5, tolerance=None).select("id", _r("score")), _eigenvector_sql(5))
_DIST = "RECURSIVE, walk(source, id, hops) AS (SELECT id, id, 0 FROM ent UNION SELECT walk.source, t, hops + 1 FROM walk JOIN edges ON walk.id = s WHERE hops < 5), dist AS (SELECT source, id, min(hops) AS hops FROM walk GROUP BY 1, 2)"
_graph("distances", lambda g: metrics.distances(g).select("source", "id", "hops"), f"{_DIST} SELECT source, id, hops FROM dist", _PLACES)
_graph("closeness", lambda g: metrics.closeness(g).select("id", _r("score")), f"{_DIST} SELECT id, round(CASE WHEN sum(hops) > 0 THEN (count(*) - 1) / sum(hops) * ((count(*) - 1) / ((SELECT count(*) FROM ent) - 1)) ELSE 0 END, 6) AS score FROM dist GROUP BY 1", _PLACES)
_BETWEEN = """, hop AS (SELECT d.source, d.id AS a, e.t AS b FROM dist d JOIN edges e ON e.s = d.id JOIN dist f ON f.source = d.source AND f.id = e.t AND f.hops = d.hops + 1),
ways(source, id, hops, n) AS (SELECT id, id, 0, 1.0::DOUBLE FROM ent),
w1 AS (SELECT h.source, h.b AS id, 1 AS hops, sum(n) AS n FROM hop h JOIN ways w ON w.source = h.source AND w.id = h.a GROUP BY 1, 2),
w2 AS (SELECT h.source, h.b AS id, 2 AS hops, sum(n) AS n FROM hop h JOIN w1 w ON w.source = h.source AND w.id = h.a GROUP BY 1, 2),
w3 AS (SELECT h.source, h.b AS id, 3 AS hops, sum(n) AS n FROM hop h JOIN w2 w ON w.source = h.source AND w.id = h.a GROUP BY 1, 2),
w4 AS (SELECT h.source, h.b AS id, 4 AS hops, sum(n) AS n FROM hop h JOIN w3 w ON w.source = h.source AND w.id = h.a GROUP BY 1, 2),
w AS (SELECT * FROM ways UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3 UNION ALL SELECT * FROM w4),
through AS (SELECT a.id, sum(a.n * b.n / c.n) AS score FROM w a JOIN w b ON b.source = a.id AND b.hops > 0 JOIN w c ON c.source = a.source AND c.id = b.id AND c.hops = a.hops + b.hops WHERE a.hops > 0 GROUP BY 1)
SELECT ent.id, round(coalesce(score, 0) / (((SELECT count(*) FROM ent) - 1) * ((SELECT count(*) FROM ent) - 2)), 6) AS score FROM ent LEFT JOIN through ON ent.id = through.id"""
_graph("betweenness", lambda g: metrics.betweenness(g).select("id", _r("score")), _DIST + _BETWEEN, _PLACES)
_graph("average_path_length", lambda g: metrics.average_path_length(g), f"{_DIST} SELECT CASE WHEN count(*) FILTER (hops > 0) = (SELECT count(*) * (count(*) - 1) FROM ent) THEN sum(hops) / count(*) FILTER (hops > 0) END AS average FROM dist", _PLACES)

# --- traversal and paths ----------------------------------------------------------------------------------------------

_STEPS = ["part-of", "part_of", "contains", "similar-to", "is-a"]
_graph("traverse_reachable", lambda g: traverse.traverse(g, "n4", 2, "both").select("node", "depth"), """RECURSIVE, step AS (SELECT source_entity AS a, target_entity AS b FROM rel UNION SELECT target_entity, source_entity FROM rel),
walk(node, depth) AS (SELECT id, 0 FROM ent WHERE id = 'n4' UNION SELECT b, depth + 1 FROM walk JOIN step ON node = a WHERE depth < 2) SELECT node, min(depth) AS depth FROM walk GROUP BY 1""", _STEPS)
_graph("traverse_outgoing", lambda g: traverse.traverse(g, "s2", 3, "outgoing", ["part-of", "part_of", "similar-to"]).select("node", "depth"), """RECURSIVE, step AS (SELECT source_entity AS a, target_entity AS b FROM rel WHERE relation_type IN ('part-of', 'part_of', 'similar-to')),
walk(node, depth) AS (SELECT id, 0 FROM ent WHERE id = 's2' UNION SELECT b, depth + 1 FROM walk JOIN step ON node = a WHERE depth < 3) SELECT node, min(depth) AS depth FROM walk GROUP BY 1""", _STEPS)
_graph("neighborhood", lambda g: traverse.neighborhood(g, "s3").select("node", "depth", "rel_id", "direction"), """, near AS (SELECT target_entity AS node, id AS rel_id, 'outgoing' AS direction, ord, 0 AS w FROM rel WHERE source_entity = 's3' UNION ALL SELECT source_entity, id, 'incoming', ord, 1 FROM rel WHERE target_entity = 's3'),
best AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w, ord, rel_id) AS n FROM near WHERE node <> 's3') SELECT 's3' AS node, 0 AS depth, NULL AS rel_id, NULL AS direction UNION ALL SELECT node, 1, rel_id, direction FROM best WHERE n = 1""")
_graph("paths_bounded", lambda g: traverse.find_paths(g, "s1", "s5", max_depth=3, relationship_types=["similar-to"]).select("path_id", "hops", F.array_join("nodes", ">").alias("nodes"), F.array_join("rel_ids", ">").alias("rels")),
       """RECURSIVE, walk(hops, last, nodes, rels, ords) AS (SELECT 0, id, [id], []::VARCHAR[], []::BIGINT[] FROM ent WHERE id = 's1' UNION ALL SELECT hops + 1, target_entity, list_append(nodes, target_entity), list_append(rels, rel.id), list_append(ords, ord)
FROM walk JOIN rel ON last = source_entity WHERE hops < 5 AND last <> 's5' AND relation_type = 'similar-to' AND NOT list_contains(nodes, target_entity))
SELECT (row_number() OVER (ORDER BY hops, ords))::INTEGER AS path_id, hops, array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels FROM walk WHERE last = 's5' ORDER BY hops, ords LIMIT 10""", ["similar-to"])  # fmt: skip
_graph("path_inference", lambda g: reason.path_inferences(traverse.path_steps(g, traverse.find_paths(g, "c1", "r0", 3).unionByName(traverse.find_paths(g, "c1", "r1", 3)).unionByName(traverse.find_paths(g, "c1", "r2", 3)).unionByName(traverse.find_paths(g, "c1", "r3", 3)).unionByName(traverse.find_paths(g, "c1", "r4", 3)))).select("type", "relation_type", "source_entity", "target_entity", _r("confidence")),
       "SELECT 'transitive_inference' AS type, 'part-of' AS relation_type, a.source_entity, b.target_entity, round(least(a.confidence, b.confidence) * 0.9::DOUBLE, 6) AS confidence FROM rel a JOIN rel b ON a.target_entity = b.source_entity WHERE a.source_entity = 'c1' AND b.relation_type = 'part-of'", ["part-of"])

# --- inference --------------------------------------------------------------------------------------------------------

_INFERRED = ["relation_type", "source_entity", "target_entity", "source_name", "target_name"]
_NAMES = "JOIN ent a ON a.id = source_entity JOIN ent b ON b.id = target_entity"
_graph("infer_symmetric", lambda g: reason.infer_symmetric(g).select(*_INFERRED, _r("confidence"), "based_on_relationship"), f", miss AS (SELECT relation_type, x.target_entity AS source_entity, x.source_entity AS target_entity, x.confidence * 0.95::DOUBLE AS c, x.id AS based_on_relationship FROM typed x WHERE kind IN ('similar-to', 'related-to', 'connected-with', 'interacts-with') AND x.confidence >= 0.7::DOUBLE AND NOT EXISTS (SELECT 1 FROM typed y WHERE y.kind = x.kind AND y.source_entity = x.target_entity AND y.target_entity = x.source_entity)) SELECT relation_type, source_entity, target_entity, a.name AS source_name, b.name AS target_name, round(c, 6) AS confidence, based_on_relationship FROM miss {_NAMES}")
_PAIRS = "('contains','part-of'),('part-of','contains'),('causes','caused-by'),('caused-by','causes')"
_graph("infer_inverse", lambda g: reason.infer_inverse(g).select(*_INFERRED, _r("confidence"), "based_on_relationship"), f", inv(kind, other) AS (VALUES {_PAIRS}), miss AS (SELECT other AS relation_type, x.target_entity AS source_entity, x.source_entity AS target_entity, x.confidence * 0.95::DOUBLE AS c, x.id AS based_on_relationship FROM typed x JOIN inv ON inv.kind = x.kind WHERE x.confidence >= 0.7::DOUBLE AND NOT EXISTS (SELECT 1 FROM typed y WHERE y.kind = other AND y.source_entity = x.target_entity AND y.target_entity = x.source_entity)) SELECT relation_type, source_entity, target_entity, a.name AS source_name, b.name AS target_name, round(c, 6) AS confidence, based_on_relationship FROM miss {_NAMES}")
_CHAINED = "chain AS (SELECT 'qualified-for' AS relation_type, x.source_entity, y.target_entity, x.confidence * y.confidence * 0.9::DOUBLE AS c FROM typed x JOIN typed y ON x.target_entity = y.source_entity WHERE x.kind = 'has-skill' AND y.kind = 'required-for' AND x.confidence >= 0.7::DOUBLE AND y.confidence >= 0.7::DOUBLE)"
_graph("infer_qualified_for", lambda g: reason.infer_chained(g).select(*_INFERRED, _r("confidence")), f", {_CHAINED} SELECT relation_type, source_entity, target_entity, a.name AS source_name, b.name AS target_name, round(c, 6) AS confidence FROM chain {_NAMES} WHERE c >= 0.7::DOUBLE")
_TRANSITIVE = """last AS (SELECT kind, source_entity AS s, target_entity AS t, arg_max(confidence, ord) AS c FROM typed WHERE kind IN ('is-a', 'part-of', 'contains', 'implies', 'causes') AND source_entity <> target_entity GROUP BY 1, 2, 3),
p2 AS (SELECT x.kind, x.s, x.t AS m, y.t, x.c * y.c AS c FROM last x JOIN last y ON x.kind = y.kind AND x.t = y.s WHERE y.t <> x.s),
p3 AS (SELECT x.kind, x.s, y.t, x.c * y.c AS c FROM p2 x JOIN last y ON x.kind = y.kind AND x.t = y.s WHERE y.t <> x.s AND y.t <> x.m),
best AS (SELECT kind, s, t, max(c) AS c, count(*) AS paths_count FROM (SELECT kind, s, t, c * pow(0.9::DOUBLE, 2) AS c FROM p2 UNION ALL SELECT kind, s, t, c * pow(0.9::DOUBLE, 3) FROM p3) GROUP BY 1, 2, 3)"""
_graph("infer_transitive", lambda g: reason.infer_transitive(g, 0.6).select(*_INFERRED, _r("confidence"), "paths_count"), f", {_TRANSITIVE} SELECT best.kind AS relation_type, best.s AS source_entity, best.t AS target_entity, a.name AS source_name, b.name AS target_name, round(best.c, 6) AS confidence, paths_count FROM best JOIN ent a ON a.id = best.s JOIN ent b ON b.id = best.t WHERE best.c >= 0.6::DOUBLE AND NOT EXISTS (SELECT 1 FROM last WHERE last.kind = best.kind AND last.s = best.s AND last.t = best.t)")
_graph("infer_all_counts", lambda g: reason.infer_new_relationships(g).groupBy("type", "relation_type").agg(F.count(F.lit(1)).alias("n")),
       f""", inv(kind, other) AS (VALUES {_PAIRS}), {_CHAINED}, {_TRANSITIVE},
every AS (SELECT 'transitive_relationship' AS type, relation_type FROM chain WHERE c >= 0.7::DOUBLE
  UNION ALL SELECT 'transitive_relationship', kind FROM best WHERE c >= 0.7::DOUBLE AND NOT EXISTS (SELECT 1 FROM last WHERE last.kind = best.kind AND last.s = best.s AND last.t = best.t)
  UNION ALL SELECT 'symmetric_relationship', relation_type FROM typed x WHERE kind IN ('similar-to', 'related-to', 'connected-with', 'interacts-with') AND x.confidence >= 0.7::DOUBLE AND NOT EXISTS (SELECT 1 FROM typed y WHERE y.kind = x.kind AND y.source_entity = x.target_entity AND y.target_entity = x.source_entity)
  UNION ALL SELECT 'inverse_relationship', other FROM typed x JOIN inv ON inv.kind = x.kind WHERE x.confidence >= 0.7::DOUBLE AND NOT EXISTS (SELECT 1 FROM typed y WHERE y.kind = other AND y.source_entity = x.target_entity AND y.target_entity = x.source_entity))
SELECT type, relation_type, count(*) AS n FROM every GROUP BY 1, 2""")  # fmt: skip

# --- conflicts --------------------------------------------------------------------------------------------------------

_opposed = lambda least: f", opp(a, b) AS (VALUES ('causes','prevents'),('prevents','causes'),('is-a','is-not-a'),('is-not-a','is-a')), con AS (SELECT x.id AS id1, y.id AS id2, x.source_entity, x.target_entity, x.kind AS type1, y.kind AS type2, least(x.confidence, y.confidence) AS c, x.confidence AS c1, y.confidence AS c2, x.ord AS ord1, y.ord AS ord2 FROM typed x JOIN opp ON x.kind = a JOIN typed y ON y.kind = b AND x.source_entity = y.source_entity AND x.target_entity = y.target_entity WHERE x.confidence >= {least}::DOUBLE AND y.confidence >= {least}::DOUBLE)"
_OPPOSED = _opposed(0.5)
_graph("conflict_contradiction", lambda g: conflicts.contradictions(g).select("id1", "id2", "source_entity", "target_entity", "type1", "type2", _r("confidence")), f"{_OPPOSED} SELECT id1, id2, source_entity, target_entity, type1, type2, round(c, 6) AS confidence FROM con")
_graph("resolve_contradiction", lambda g: conflicts.resolve_contradictions(g).rels.select("id"), f"{_OPPOSED} SELECT rel.id FROM rel ANTI JOIN (SELECT DISTINCT CASE WHEN c1 >= c2 THEN id2 ELSE id1 END AS id FROM con WHERE ord1 < ord2) gone ON rel.id = gone.id")
_PROPS = ", attr AS (SELECT id, name, entity_type, confidence, ord, unnest(['brand', 'kind', 'segment', 'size']) AS key, unnest([a_brand, a_kind, a_segment, a_size]) AS value FROM ent WHERE confidence >= 0.9::DOUBLE), pc AS (SELECT x.id AS id1, y.id AS id2, x.name, x.key, x.value AS value1, y.value AS value2, x.confidence AS c1, y.confidence AS c2, x.ord AS o1, y.ord AS o2 FROM attr x JOIN attr y ON x.name = y.name AND x.entity_type = y.entity_type AND x.key = y.key AND x.ord < y.ord AND x.value <> y.value)"
_entities("conflict_property", lambda g: conflicts.property_conflicts(g, 0.9).select("id1", "id2", "name", "key", "value1", "value2"), f"{_PROPS} SELECT id1, id2, name, key, value1, value2 FROM pc")
_graph("resolve_property", lambda g: conflicts.resolve_property_conflicts(g, least=0.9).nodes.select("id", F.element_at("attributes", "brand").alias("brand"), F.element_at("attributes", "size").alias("size")),
       f"{_PROPS}, up AS (SELECT CASE WHEN c1 >= c2 THEN id2 ELSE id1 END AS id, key, CASE WHEN c1 >= c2 THEN value1 ELSE value2 END AS value, CASE WHEN c1 >= c2 THEN c1 ELSE c2 END AS c, CASE WHEN c1 >= c2 THEN o1 ELSE o2 END AS o FROM pc), best AS (SELECT id, key, arg_max(value, row(c, -o)) AS value FROM up GROUP BY 1, 2) SELECT ent.id, coalesce(b.value, a_brand) AS brand, coalesce(z.value, a_size) AS size FROM ent LEFT JOIN best b ON b.id = ent.id AND b.key = 'brand' LEFT JOIN best z ON z.id = ent.id AND z.key = 'size'")


def _all_cycles(edges: str, longest: int = 4) -> str:
    """Tables: ``hier`` (kind, s, t), and ``cyc`` with its cycles up to ``longest`` edges and a shortest one of each component that has only longer ones."""
    return f"""RECURSIVE, hier AS (SELECT DISTINCT kind, s, t FROM ({edges}) WHERE s <> t),
walk(kind, start, last, nodes, n) AS (SELECT kind, s, t, [s, t], 2 FROM hier WHERE t > s UNION ALL SELECT w.kind, start, t, list_append(nodes, t), n + 1 FROM walk w JOIN hier h ON w.kind = h.kind AND last = h.s WHERE t > start AND NOT list_contains(nodes, t) AND n < {longest}),
short AS (SELECT w.kind, start, nodes, n AS length FROM walk w JOIN hier h ON w.kind = h.kind AND last = h.s AND h.t = start),
reach(kind, a, b) AS (SELECT kind, s, t FROM hier UNION SELECT reach.kind, a, t FROM reach JOIN hier ON reach.kind = hier.kind AND b = s),
part AS (SELECT x.kind, x.a AS node, min(x.b) AS c FROM reach x JOIN reach y ON x.kind = y.kind AND x.a = y.b AND x.b = y.a GROUP BY 1, 2),
silent AS (SELECT kind, node, c FROM part WHERE (kind, c) NOT IN (SELECT (part.kind, part.c) FROM short JOIN part ON short.kind = part.kind AND short.start = part.node)),
round_(kind, c, last, nodes) AS (SELECT DISTINCT kind, c, c, [c] FROM silent UNION ALL SELECT w.kind, w.c, h.t, list_append(nodes, h.t) FROM round_ w JOIN hier h ON w.kind = h.kind AND last = h.s
  JOIN silent ON silent.kind = h.kind AND silent.node = h.t AND silent.c = w.c WHERE NOT list_contains(nodes, h.t)),
long_ AS (SELECT w.kind, c AS start, arg_min(nodes, row(len(nodes), nodes)) AS nodes FROM round_ w JOIN hier h ON w.kind = h.kind AND last = h.s AND h.t = c GROUP BY 1, 2),
cyc AS (SELECT kind AS relation_type, start, nodes, length FROM short UNION ALL SELECT kind, start, nodes, len(nodes) FROM long_)"""


_hier = lambda least: f"SELECT kind, source_entity AS s, target_entity AS t FROM typed WHERE kind IN ('is-a', 'part-of', 'contains') AND confidence >= {least}::DOUBLE"
_CYCLES = _all_cycles(_hier(0.5))
_graph("conflict_cycles", lambda g: conflicts.circular_hierarchies(g).select("relation_type", "start", F.array_join("nodes", ">").alias("nodes"), "length"), f"{_CYCLES} SELECT relation_type, start, array_to_string(nodes, '>') AS nodes, length::INTEGER AS length FROM cyc", ["is-a", "part-of", "part_of", "contains"])
_graph("resolve_cycle", lambda g: conflicts.resolve_cycles(g).rels.select("id"), f"{_CYCLES}, hop AS (SELECT relation_type, start, nodes, nodes[i] AS s, nodes[i % length + 1] AS t FROM cyc, range(1, 100) r(i) WHERE i <= length), gone AS (SELECT arg_min(typed.id, row(confidence, ord)) AS id FROM hop JOIN typed ON kind = hop.relation_type AND source_entity = s AND target_entity = t GROUP BY hop.relation_type, start, nodes) SELECT rel.id FROM rel ANTI JOIN gone ON rel.id = gone.id", ["is-a", "part-of", "part_of", "contains"])
_graph("detect_conflicts_counts", lambda g: conflicts.conflict_counts(g, 0.6),
       f"""{_all_cycles(_hier(0.6))}{_opposed(0.6)}{_PROPS.replace("0.9", "0.6")}, found AS (SELECT 'contradictory_relationship' AS type, 'high' AS severity FROM con UNION ALL SELECT 'property_conflict', 'medium' FROM (SELECT DISTINCT id1, id2 FROM pc) UNION ALL SELECT 'circular_hierarchy', 'high' FROM cyc)
SELECT type, severity, count(*) AS n FROM found GROUP BY 1, 2""")  # fmt: skip
_graph("resolve_actions_counts", lambda g: conflicts.action_counts(g, 0.6),
       f"""{_all_cycles(_hier(0.6))}{_opposed(0.6)}{_PROPS.replace("0.9", "0.6")}, found AS (SELECT 'remove_relationship' AS action_type FROM con
  UNION ALL SELECT 'merge_entity_attributes' FROM (SELECT DISTINCT CASE WHEN c1 >= c2 THEN id1 ELSE id2 END, CASE WHEN c1 >= c2 THEN id2 ELSE id1 END FROM pc) UNION ALL SELECT 'break_cycle' FROM cyc)
SELECT action_type, count(*) AS n FROM found GROUP BY 1""")  # fmt: skip

# --- verification -----------------------------------------------------------------------------------------------------


def _raw(build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(raw_entities(spark, sf_dir), raw_relationships(spark, sf_dir))


_DANGLING = "dang AS (SELECT id, 'source' AS endpoint, source_entity AS missing FROM raw WHERE source_entity NOT IN (SELECT id FROM ent) UNION ALL SELECT id, 'target', target_entity FROM raw WHERE target_entity NOT IN (SELECT id FROM ent))"
_add("verify_dangling", oracle(f", {_DANGLING} SELECT * FROM dang"))(_raw(verify.dangling_references))
_VERIFY = "opp(a, b) AS (VALUES ('causes','prevents'),('prevents','causes'),('is-a','is-not-a'),('is-not-a','is-a')), dir AS (SELECT DISTINCT * FROM (SELECT id, source_entity, target_entity, relation_type, ord FROM rel UNION ALL SELECT id, target_entity, source_entity, relation_type, ord FROM rel WHERE bidirectional)), con AS (SELECT x.id AS id1, y.id AS id2, x.source_entity, x.target_entity, x.relation_type AS type1, y.relation_type AS type2 FROM dir x JOIN opp ON x.relation_type = a JOIN dir y ON y.relation_type = b AND x.source_entity = y.source_entity AND x.target_entity = y.target_entity AND x.ord < y.ord)"
_add("verify_contradiction", oracle(f", {_VERIFY} SELECT * FROM con"))(_raw(verify.contradictory_types))
_VHIER = "SELECT 'h' AS kind, source_entity AS s, target_entity AS t FROM raw WHERE lower(relation_type) IN ('is-a', 'part-of', 'subclass-of', 'contains', 'includes')"
_VCYCLES = f"{_all_cycles(_VHIER)} SELECT start, array_to_string(nodes, '>') AS nodes, length::INTEGER AS length FROM cyc"
_add("verify_cycles", oracle(_VCYCLES))(_raw(lambda e, r: verify.hierarchy_cycles(r).select("start", F.array_join("nodes", ">").alias("nodes"), "length")))
# A least distance is below the number of entities within reach, so the walk is bounded without leaving anything out.
_VFAR = """, step AS (SELECT DISTINCT lower(relation_type) AS kind, source_entity AS s, target_entity AS t FROM raw WHERE lower(relation_type) IN ('is-a', 'part-of', 'subclass-of')),
deny AS (SELECT id, source_entity, target_entity FROM raw WHERE lower(relation_type) IN ('is-not-a', 'different-from', 'separate-from')),
afar(kind, start, node) AS (SELECT kind, s, t FROM step WHERE s IN (SELECT source_entity FROM deny) AND s <> t UNION SELECT afar.kind, start, t FROM afar JOIN step ON afar.kind = step.kind AND node = s WHERE t <> start),
most AS (SELECT coalesce(max(n), 0) AS most FROM (SELECT count(*) AS n FROM afar GROUP BY kind, start)),
onward(kind, start, node, n) AS (SELECT kind, s, t, 1 FROM step WHERE s IN (SELECT source_entity FROM deny) AND s <> t UNION SELECT w.kind, start, t, n + 1 FROM onward w JOIN step ON w.kind = step.kind AND node = s WHERE n < (SELECT most FROM most) AND t <> start),
far AS (SELECT kind, start, node, min(n) AS n FROM onward GROUP BY 1, 2, 3),
denied AS (SELECT kind AS relation_type, start AS source_entity, node AS target_entity, n AS distance, id AS contradiction FROM far JOIN deny ON start = source_entity AND node = target_entity WHERE n >= 2)"""
_VTRANS = f"RECURSIVE{_VFAR} SELECT * FROM denied"
_add("verify_transitive_contradiction", oracle(_VTRANS))(_raw(lambda e, r: verify.transitive_contradictions(r)))
_add("verify_all", oracle(f"""{_all_cycles(_VHIER)}{_VFAR}, {_DANGLING}, {_VERIFY},
found AS (SELECT 'dangling_reference' AS issue_type, 'critical' AS severity FROM dang UNION ALL SELECT 'cyclic_dependency', 'critical' FROM cyc
  UNION ALL SELECT 'contradictory_relationships', 'medium' FROM con UNION ALL SELECT 'transitive_contradiction', 'medium' FROM denied)
SELECT issue_type, severity, count(*) AS n FROM found GROUP BY 1, 2"""))(_raw(lambda e, r: verify.verify(e, r).groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("n"))))

# --- registries and changes -------------------------------------------------------------------------------------------

_graph("registry_dedup", lambda g: registry.deduplicate(g.nodes).select("id", "name", "entity_type", _r("confidence"), F.element_at("attributes", "segment").alias("segment")),
       """, g AS (SELECT arg_min(id, ord) AS id, arg_max(name, row(confidence, -ord)) AS name, entity_type, round(max(confidence), 6) AS confidence, list(DISTINCT a_segment) FILTER (a_segment IS NOT NULL) AS v,
  trim(lower(name)) AS k FROM ent GROUP BY trim(lower(name)), entity_type) SELECT id, name, entity_type, confidence, CASE WHEN len(v) = 1 THEN v[1] END AS segment FROM g""")  # fmt: skip
_graph("registry_dedup_attributes", lambda g: registry.deduplicate(g.nodes).where("entity_type = 'Part'").select("id", F.element_at("attributes", "size").alias("size"), F.length("context").cast("bigint").alias("context_length")),
       """, p AS (SELECT *, trim(lower(name)) AS k FROM ent WHERE entity_type = 'Part'), s AS (SELECT k, a_size, min(ord) AS o FROM p GROUP BY 1, 2),
c AS (SELECT k, context, min(ord) AS o FROM p GROUP BY 1, 2), l AS (SELECT k, sum(length(context)) + count(*) - 1 AS n FROM c GROUP BY 1)
SELECT (SELECT arg_min(id, ord) FROM p WHERE p.k = s.k) AS id, CASE WHEN count(*) = 1 THEN min(a_size) ELSE '[' || string_agg(a_size, ',' ORDER BY o) || ']' END AS size, (SELECT n::BIGINT FROM l WHERE l.k = s.k) AS context_length FROM s GROUP BY s.k""")  # fmt: skip
_graph("merge_entities", lambda g: g.merge_entities(["s1", "s2", "s3"], entity_frame(g.entities.sparkSession, [{"id": "merged", "name": "Merged", "type": "Supplier", "ord": 1}])).rels.select("id", "source_entity", "target_entity"),
       ", m AS (SELECT *, source_entity IN ('s1','s2','s3') AS a, target_entity IN ('s1','s2','s3') AS b FROM rel) SELECT CASE WHEN a OR b THEN id || '_merged' ELSE id END AS id, CASE WHEN a THEN 'merged' ELSE source_entity END AS source_entity, CASE WHEN b THEN 'merged' ELSE target_entity END AS target_entity FROM m WHERE NOT ((a OR b) AND source_entity = target_entity)")
_graph("remove_entity", lambda g: g.remove_entities(["n1", "p30"]).rels.select("id"), "SELECT id FROM rel WHERE source_entity NOT IN ('n1', 'p30') AND target_entity NOT IN ('n1', 'p30')")
_graph("remove_relationship", lambda g: g.remove_relationships(["cn1", "nr2"]).rels.select("id"), "SELECT id FROM rel WHERE id NOT IN ('cn1', 'nr2')")
_graph("add_entity", lambda g: g.add_entities(entity_frame(g.entities.sparkSession, [{"id": "n1", "name": "Renamed", "type": "Nation"}, {"id": "new", "name": "New", "type": "Nation"}])).nodes.select("id", "name", "entity_type"),
       "SELECT id, CASE id WHEN 'n1' THEN 'Renamed' ELSE name END AS name, entity_type FROM ent UNION ALL SELECT 'new', 'New', 'Nation'")
_graph("relationship_reverse", lambda g: reverse(g.rels).select("id", "source_entity", "target_entity"), "SELECT id || '_reversed' AS id, target_entity AS source_entity, source_entity AS target_entity FROM rel")
_entities("coref_edit", lambda g: coref.similar_pairs(g.nodes, measure="edit", digits=6).select("id1", "id2", "similarity"),
       f", x AS (SELECT id, ord, entity_type, trim(lower(name)) AS n FROM ent), s AS (SELECT a.id AS id1, b.id AS id2, 1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)) AS similarity FROM x a JOIN x b ON a.entity_type = b.entity_type AND a.ord < b.ord) SELECT id1, id2, round(similarity, 6) AS similarity FROM s WHERE similarity >= {coref.THRESHOLD}")
_entities("coref_ratio", lambda g: coref.similar_pairs(g.nodes, digits=6).select("id1", "id2", "similarity"), None)
_entities("coref_groups", lambda g: coref.resolved_groups(g).select("canonical_name", F.size("entity_ids").alias("n"), _r("confidence")), None)

# --- text -------------------------------------------------------------------------------------------------------------


def _text(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    _add(name, sql)(lambda spark, sf_dir: build(_docs(spark, sf_dir)))


_trim = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _normal(x: str) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\\r\\n|\\r', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    return _trim(f"array_to_string(list_transform(string_split({out}, chr(10)), lambda l: {_trim('l')}), chr(10))")


_text("text_normalize", lambda d: d.select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("h")), f"SELECT doc_id, md5({_normal('text')}) AS h FROM documents")
_text("text_normalize_loaded", lambda d: d.select("doc_id", F.md5(text.normalize_loaded(F.col("text"))).alias("h")), f"SELECT doc_id, md5({_trim(chr(39).join(['regexp_replace(text, ', chr(92) + 's+', ', ', ' ', ', ', 'g', ')']))}) AS h FROM documents")
_text("text_paragraphs", lambda d: d.select("doc_id", F.posexplode(text.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("i", "p")).select("doc_id", "i", F.md5("p").alias("h")),
      f"SELECT doc_id, (i - 1)::INTEGER AS i, md5(p[i]) AS h FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array({_normal('replace(text, chr(10), chr(10) || chr(10))')}, '\\n\\n+'), lambda x: trim(x) <> '') AS p FROM documents))")
_text("text_truncate", lambda d: d.select("doc_id", text.truncate(F.col("text"), 80).alias("cut")), "SELECT doc_id, CASE WHEN length(text) <= 80 THEN text WHEN regexp_matches(left(text, 80), '(?s)^.+ ') THEN regexp_extract(left(text, 80), '(?s)^(.+) ', 1) || '...' ELSE left(text, 80) || '...' END AS cut FROM documents")
_text("text_tokens", lambda d: d.select("doc_id", text.approximate_tokens(F.col("text")).alias("n")), f"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, length({_trim('text')}) // 4) END::BIGINT AS n FROM documents")
_text("text_split_point", lambda d: d.select("doc_id", text.best_split_point(F.col("text"), 500).alias("at")), None)
_MD = "'# ' || replace(text, ' the ', ' **the** [link](u) `c` ')"
_md_sql = _MD
for _p, _to in (("(?m)^#+\\s+", ""), ("\\*\\*(.*?)\\*\\*", "\\1"), ("\\*(.*?)\\*", "\\1"), ("__(.*?)__", "\\1"), ("_(.*?)_", "\\1"), ("```(?:[^`]*)\\n([\\s\\S]*?)\\n```", "\\1"), ("`([^`]*)`", "\\1"), ("\\[(.*?)\\]\\(.*?\\)", "\\1"), ("!\\[(.*?)\\]\\(.*?\\)", "\\1"), ("(?m)^-{3,}$", ""), ("(?m)^\\s*[-*+]\\s+", ""), ("(?m)^\\s*\\d+\\.\\s+", "")):
    _md_sql = f"regexp_replace({_md_sql}, '{_p}', '{_to}', 'g')"
_text("strip_markdown", lambda d: d.select("doc_id", F.md5(text.strip_markdown(F.concat(F.lit("# "), F.replace("text", F.lit(" the "), F.lit(" **the** [link](u) `c` "))))).alias("h")), f"SELECT doc_id, md5({_normal(_md_sql)}) AS h FROM documents")
_markers = " OR ".join(f"contains(text, '{m}')" for m in text.CODE_MARKERS)
_clean = "regexp_replace(text, '[\\s\\.,;:!?''\"()\\[\\]{}]', '', 'g')"
_text("is_natural_language", lambda d: d.select("doc_id", text.is_natural_language(F.col("text")).alias("natural")),
      f"SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 10 OR {_markers} THEN false WHEN length({_clean}) > 0 AND length(regexp_replace({_clean}, '[\\p{{L}}\\p{{N}}]', '', 'g')) / length({_clean}) > 0.3 THEN false WHEN len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) = 0 THEN false ELSE regexp_matches(text, '[A-ZА-Я].*?[.!?]') AND list_avg(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w))) BETWEEN 3 AND 10 END AS natural FROM documents")
_text("outermost_json", lambda d: d.select("doc_id", text.outermost_json(F.concat(F.lit("say {"), "text", F.lit("} end"))).alias("j")), "SELECT doc_id, regexp_extract('say {' || text || '} end', '(?s)\\{.*\\}', 0) AS j FROM documents")
_text("language_names", lambda d: d.select("doc_id", language.language_name(F.upper("lang")).alias("name"), language.is_supported(F.col("lang")).alias("supported"), language.closest_supported(F.col("lang")).alias("closest")),
      "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'Français' WHEN 'de' THEN 'Deutsch' WHEN 'es' THEN 'Español' ELSE upper(lang) END AS name, lang IN ('ru', 'en') AS supported, 'en' AS closest FROM documents")
_text("language_detect", lambda d: d.select("doc_id", language.detect_language(F.col("text")).alias("language")), None)
_SENT = "list_filter(string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_text("segment_sentences", lambda d: segment.rule_segments(d.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))).where("level = 2").select("doc_id", "id", F.md5("text").alias("h")),
      f"""WITH para AS (SELECT doc_id::VARCHAR AS doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: {_trim('x')}), lambda x: x <> '') AS ps FROM documents),
one AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM para), sen AS (SELECT doc_id, i, {_SENT} AS ss FROM one WHERE length(p) > 200)
SELECT doc_id, doc_id || '.' || i || '.' || k AS id, md5(ss[k]) AS h FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS k FROM sen)""")  # fmt: skip
_text("segment_paragraphs", lambda d: segment.rule_segments(d.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))).where("level = 1").select("doc_id", "id", "start", "end", F.size("children_ids").alias("n")),
      f"""WITH para AS (SELECT doc_id::VARCHAR AS doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: {_trim('x')}), lambda x: x <> '') AS ps FROM documents),
one AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p, ps FROM para), spot AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE list_sum(list_transform(ps[1:i - 1], lambda x: length(x) + 2)) END AS start FROM one)
SELECT doc_id, doc_id || '.' || i AS id, start::INTEGER AS start, (start + length(p))::INTEGER AS end, CASE WHEN length(p) > 200 THEN len({_SENT}) ELSE 0 END::INTEGER AS n FROM spot""")  # fmt: skip
_text("segment_hierarchy", lambda d: segment.hierarchy(segment.rule_segments(d.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))).groupBy("depth").agg(F.count(F.lit(1)).alias("n")),
      f"""WITH para AS (SELECT list_filter(list_transform(regexp_split_to_array(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: {_trim('x')}), lambda x: x <> '') AS ps FROM documents), one AS (SELECT unnest(ps) AS p FROM para),
every AS (SELECT 0 AS depth FROM documents UNION ALL SELECT 1 FROM one UNION ALL SELECT 2 FROM (SELECT unnest({_SENT}) FROM one WHERE length(p) > 200))
SELECT depth, count(*) AS n FROM every GROUP BY 1""")  # fmt: skip
_text("extract_segments_pack", lambda d: segment.packed_segments(d.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))).select("doc_id", "id", "position", "length"),
      f"""WITH RECURSIVE para AS (SELECT doc_id::VARCHAR AS doc_id, list_filter(regexp_split_to_array({_normal('replace(text, chr(10), chr(10) || chr(10))')}, '\\n\\n+'), lambda x: trim(x) <> '') AS ps FROM documents),
fold(doc_id, ps, i, cur, pos, seg, done, dpos, dlen) AS (SELECT doc_id, ps, 0, 0, 0, 1, false, 0, 0 FROM para UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN full_ THEN l WHEN cur = 0 THEN l ELSE cur + 2 + l END, CASE WHEN full_ THEN pos + l + 2 ELSE pos END, CASE WHEN full_ THEN seg + 1 ELSE seg END, full_, pos, cur
  FROM (SELECT *, length(ps[i + 1]) AS l, cur + length(ps[i + 1]) + 2 > 1000 AND cur > 0 AS full_ FROM fold WHERE i < len(ps)))
SELECT doc_id, 'seg_' || (seg - 1) AS id, dpos::INTEGER AS position, dlen::INTEGER AS length FROM fold WHERE done UNION ALL SELECT doc_id, 'seg_' || seg, pos::INTEGER, cur::INTEGER FROM fold WHERE i = len(ps) AND cur > 0""")  # fmt: skip
_text("summary_cache_key", lambda d: d.select("doc_id", summarize.cache_key(F.col("text"), F.lit("document"), F.col("lang")).alias("key")), "SELECT doc_id, md5(concat_ws('|', text, 'document', lang)) AS key FROM documents")


@_add("summaries", f"""WITH t AS (SELECT doc_id::VARCHAR AS segment_id, text FROM documents WHERE length({_trim('text')}) >= 10),
w AS (SELECT segment_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}][\\p{{L}}\\p{{N}}_''-]*')) AS w FROM t), c AS (SELECT segment_id, w, count(*) AS n FROM w WHERE length(w) > 4 GROUP BY 1, 2),
k AS (SELECT segment_id, string_agg(w, ',' ORDER BY n DESC, w) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY n DESC, w) AS i FROM c) WHERE i <= 5 GROUP BY 1)
SELECT t.segment_id, md5(coalesce(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_trim('x')} <> '')[1], '')) AS summary, coalesce(keywords, '') AS keywords FROM t LEFT JOIN k ON t.segment_id = k.segment_id""")
def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text", F.lit("document").alias("segment_type"))
    return summarize.summarize(segments)[0].select("segment_id", F.md5("summary").alias("summary"), F.array_join("keywords", ",").alias("keywords"))


@_add("extract_graph")
def _extract_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    segments = rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.lit("turn").alias("segment_type"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("title"))
    return extract.extract_graph(segments).nodes.select("id", "name", "entity_type", _r("confidence"))


_add("entities_in_context", "SELECT d.doc_id::VARCHAR AS segment_id, 'q' || item_id AS entity_id FROM documents d JOIN (SELECT item_id, text AS q FROM benchmark) b ON contains(d.text, q)")(
    lambda spark, sf_dir: extract.entities_in_segments(
        _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.concat(F.lit("q"), "item_id").alias("id"), F.lit("q").alias("name"), F.col("text").alias("context")), strict=True,
    ).select("segment_id", "entity_id")
)

# --- output forms -----------------------------------------------------------------------------------------------------

_graph("cypher_relationships", lambda g: graph_io.cypher_relationships(g).select("line"), "SELECT 'MATCH (a:Entity {id: ''' || source_entity || '''}), (b:Entity {id: ''' || target_entity || '''}) CREATE (a)-[r:' || upper(replace(relation_type, ' ', '_')) || ' {id: ''' || id || ''', confidence: ' || confidence || ', strength: ' || strength || '}]->(b)' AS line FROM rel")
_graph("cypher_nodes", lambda g: graph_io.cypher_nodes(g).select("line"), "SELECT 'CREATE (e:' || entity_type || ' {id: ''' || id || ''', name: ''' || replace(name, '''', '\\''') || ''', confidence: ' || confidence || coalesce(', brand: ''' || replace(a_brand, '\"', '') || '''', '') || coalesce(', kind: ''' || replace(a_kind, '\"', '') || '''', '') || coalesce(', segment: ''' || replace(a_segment, '\"', '') || '''', '') || coalesce(', size: ' || a_size, '') || '})' AS line FROM ent")
_graph("viz_node_style", lambda g: viz.node_styles(g), "SELECT id, name || '<br><i>' || entity_type || '</i>' || CASE entity_type WHEN 'Part' THEN '<br>brand: ' || replace(a_brand, '\"', '') || '<br>kind: ' || replace(a_kind, '\"', '') || '<br>size: ' || a_size WHEN 'Customer' THEN '<br>segment: ' || replace(a_segment, '\"', '') ELSE '' END || '<br>confidence: ' || printf('%.2f', confidence) AS label, CASE entity_type WHEN 'Skill' THEN '#20B2AA' WHEN 'Job' THEN '#CD5C5C' ELSE '#A9A9A9' END AS color, 'box' AS shape, CASE WHEN confidence > 0.8::DOUBLE THEN 30 ELSE 20 END AS size FROM ent")
_COLOR = "CASE lower(relation_type) WHEN 'is-a' THEN '#0000CD' WHEN 'part-of' THEN '#2E8B57' WHEN 'causes' THEN '#B22222' WHEN 'has-skill' THEN '#228B22' ELSE '#696969' END"
_EDGE = f"relation_type AS label, relation_type || ' (confidence: ' || printf('%.2f', confidence) || ')' AS title, {_COLOR} AS color, round(1 + 4 * confidence, 6) AS width"
_graph("viz_edge_style", lambda g: viz.edge_styles(g).withColumn("width", F.round("width", 6)), f"SELECT source_entity AS source, target_entity AS target, {_EDGE} FROM rel UNION ALL SELECT target_entity, source_entity, {_EDGE} FROM rel WHERE bidirectional")
_graph("viz_filtered", lambda g: viz.filtered(g, ["Supplier", "Nation"], ["part_of", "similar-to"], 0.7).rels.select("id"), "SELECT id FROM rel WHERE confidence >= 0.7::DOUBLE AND relation_type IN ('part_of', 'similar-to') AND source_entity IN (SELECT id FROM ent WHERE confidence >= 0.7::DOUBLE AND entity_type IN ('Supplier', 'Nation')) AND target_entity IN (SELECT id FROM ent WHERE confidence >= 0.7::DOUBLE AND entity_type IN ('Supplier', 'Nation'))")
_graph("graphml_lines", lambda g: graph_io.graphml_lines(g).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars")),
       r""", x AS (SELECT *, '{' || concat_ws(',', '"brand":' || to_json(a_brand)::VARCHAR, '"kind":' || to_json(a_kind)::VARCHAR, '"segment":' || to_json(a_segment)::VARCHAR, '"size":' || to_json(a_size)::VARCHAR) || '}' AS attributes FROM ent),
esc AS (SELECT length('<node id=""></node>') + length(id) + sum(length('<data key="' || k || '">||</data>') + length(replace(replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'))) AS n
  FROM (SELECT id, unnest(['label', 'entity_type', 'confidence', 'attributes', 'context', 'metadata', 'ord']) AS k, unnest([name, entity_type, confidence::VARCHAR, attributes, context, '{}', ord::VARCHAR]) AS v FROM x) WHERE v IS NOT NULL GROUP BY id),
re AS (SELECT length('<edge id="" source="" target=""></edge>') + length(id) + length(source_entity) + length(target_entity) + sum(length('<data key="' || k || '">||</data>') + length(v)) AS n
  FROM (SELECT id, source_entity, target_entity, unnest(['relation_type', 'confidence', 'strength', 'attributes', 'bidirectional', 'context', 'metadata', 'ord']) AS k, unnest([relation_type, confidence::VARCHAR, strength::VARCHAR, '{}', bidirectional::VARCHAR, relation_type || ' by rule', '{}', ord::VARCHAR]) AS v FROM rel) GROUP BY id, source_entity, target_entity, n_()),
head AS (SELECT unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<graph edgedefault="directed">']) AS line
  UNION ALL SELECT '<key id="' || k || '" for="' || f || '" attr.name="' || k || '" attr.type="string"/>' FROM (VALUES ('label', 'node'), ('entity_type', 'node'), ('confidence', 'all'), ('attributes', 'all'), ('relation_type', 'edge'), ('strength', 'edge'), ('bidirectional', 'edge'), ('context', 'all'), ('metadata', 'all'), ('ord', 'all')) t(k, f))
SELECT 0 AS part, count(*) AS n, sum(length(line))::BIGINT AS chars FROM head UNION ALL SELECT 1, count(*), sum(n)::BIGINT FROM esc UNION ALL SELECT 2, count(*), sum(n)::BIGINT FROM re UNION ALL SELECT 3, 1, length('</graph></graphml>')""".replace(", n_()", ""))  # fmt: skip
_add("sanitize_name", "SELECT p_partkey, replace(replace(replace(p_name, ' ', '_'), '/', '_'), '\\', '_') AS name FROM part")(
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.translate("p_name", " /\\", "___").alias("name"))
)
_add("activity_edges", "SELECT date_trunc('hour', ts) AS window_start, 'u' || user_id AS source_entity, event_type AS target_entity, count(*) AS weight, round(sum(value), 4) AS value FROM events GROUP BY 1, 2, 3")(
    lambda spark, sf_dir: upsert.activity(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("value", F.round("value", 4))
)


# --- storage, validation, parsing and formatting ----------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/graphwright/store-{uuid.uuid4().hex}"


def _stored(build: Callable[[GraphStore, KG], DataFrame]) -> Callable[[KG], DataFrame]:
    """A query over a store that holds two versions of the graph."""

    def run(g: KG) -> DataFrame:
        kept = GraphStore(g.entities.sparkSession, _folder(g.entities.sparkSession))
        first = kept.save(g, "places and more")
        kept.save(g.remove_entities(["r0"]), "places and more", "without one region")
        kept.describe("places and more", first, "all")
        return build(kept, g)

    return run


_graph("store_list_graphs", _stored(lambda st, g: st.list_graphs().select("graph", "versions", "entity_count", "relationship_count")),
       "SELECT 'places_and_more' AS graph, 2::BIGINT AS versions, (SELECT count(*) FROM ent WHERE id <> 'r0') AS entity_count, (SELECT count(*) FROM rel WHERE source_entity <> 'r0' AND target_entity <> 'r0') AS relationship_count")
_graph("store_list_versions", _stored(lambda st, g: st.list_versions("places and more").select("entity_count", "relationship_count", "description")),
       "SELECT count(*) AS entity_count, (SELECT count(*) FROM rel) AS relationship_count, 'all' AS description FROM ent UNION ALL SELECT (SELECT count(*) FROM ent WHERE id <> 'r0'), (SELECT count(*) FROM rel WHERE source_entity <> 'r0' AND target_entity <> 'r0'), 'without one region'")
_graph("store_load_current", _stored(lambda st, g: st.load("places and more").rels.select(*_REL)), "SELECT id, source_entity, target_entity, relation_type FROM rel WHERE source_entity <> 'r0' AND target_entity <> 'r0'")
_graph("store_load_version", _stored(lambda st, g: st.load("places and more", st.list_versions("places and more").collect()[-1]["version_id"]).nodes.select("id", "name", _r("confidence"))), "SELECT id, name, round(confidence, 6) AS confidence FROM ent")


def _through(format: str, read: str) -> Callable[[KG], KG]:
    def run(g: KG) -> KG:
        path = _folder(g.entities.sparkSession)
        graph_io.export(g, path, format)
        return graph_io.import_graph(g.entities.sparkSession, path, read)

    return run


_ENT_ALL = lambda d: d.select("id", "name", "entity_type", "context", F.element_at("attributes", "brand").alias("brand"), F.element_at("attributes", "size").alias("size"), F.size("metadata").alias("facts"), "confidence", "ord")
_ENT_ALL_SQL = "SELECT id, name, entity_type, context, a_brand AS brand, a_size AS size, 0 AS facts, confidence, ord FROM ent"
_REL_ALL = lambda d: d.select(*_REL, "context", F.size("attributes").alias("values"), F.size("metadata").alias("facts"), "bidirectional", "strength", "confidence", "ord")
_REL_ALL_SQL = "SELECT id, source_entity, target_entity, relation_type, relation_type || ' by rule' AS context, 0 AS values, 0 AS facts, bidirectional, strength, confidence, ord FROM rel"
_graph("json_lines_round_trip", lambda g: _ENT_ALL(_through("json", "json")(g).nodes), _ENT_ALL_SQL)
_graph("json_round_trip_relationships", lambda g: _REL_ALL(_through("json", "json")(g).rels), _REL_ALL_SQL)
_graph("graphml_round_trip", lambda g: _REL_ALL(_through("graphml", "graphml")(g).rels), _REL_ALL_SQL)
_graph("graphml_round_trip_entities", lambda g: _ENT_ALL(_through("graphml", "graphml")(g).nodes), _ENT_ALL_SQL)
_graph("from_registries", lambda g: graph_io.from_registries(g.entities, g.relationships).rels.select("id"), "SELECT id FROM rel")
_add("from_extraction", "SELECT 'e' || r_regionkey AS id, r_name AS name, 'Region' AS entity_type FROM region")(
    lambda spark, sf_dir: graph_io.from_extraction(
        spark, {"entities": [{"name": r.r_name, "type": "Region"} for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()]}
    ).nodes.select("id", "name", "entity_type")
)
_graph("validate_entities", lambda g: validate_entities(g.nodes.withColumn("confidence", F.col("confidence") + 0.2).withColumn("name", F.when(F.col("id").startswith("b"), "").otherwise(F.col("name"))))[1].select("id", "reason"),
       "SELECT id, CASE WHEN id LIKE 'b%' THEN 'empty name' ELSE 'confidence outside [0, 1]' END AS reason FROM ent WHERE id LIKE 'b%' OR confidence + 0.2::DOUBLE > 1")
_graph("validate_relationships", lambda g: validate_relationships(g.rels.withColumn("strength", F.col("strength") + 0.2))[0].select("id"), "SELECT id FROM rel WHERE strength + 0.2::DOUBLE <= 1")
_graph("verify_is_valid", lambda g: verify.is_valid(verify.verify(g.nodes, g.rels)), "SELECT true AS is_valid, 0::BIGINT AS issues", ["supplies"])
_graph("entity_lines", lambda g: verify.entity_lines(g.nodes).select("line"), "SELECT '- [' || id || '] ' || name || ' (' || entity_type || ')' AS line FROM ent")
_graph("relationship_lines", lambda g: verify.relationship_lines(g.nodes, g.rels).select("line"), "SELECT '- [' || rel.id || '] ' || a.name || ' --' || relation_type || '--> ' || b.name AS line FROM rel JOIN ent a ON a.id = source_entity JOIN ent b ON b.id = target_entity")
_graph("strongest_per_pair", lambda g: conflicts.strongest_per_pair(g).select("id", "source_entity", "target_entity"), "SELECT id, source_entity, target_entity FROM (SELECT *, row_number() OVER (PARTITION BY source_entity, target_entity ORDER BY confidence DESC, ord) AS n FROM rel) WHERE n = 1")
_graph("id_map", lambda g: registry.id_map(g.nodes).select("old_id", "new_id"), "SELECT id AS old_id, first_value(id) OVER (PARTITION BY trim(lower(name)), entity_type ORDER BY ord) AS new_id FROM ent")
_graph("repoint", lambda g: registry.repoint(g.rels, registry.id_map(g.nodes)).select("id", "source_entity", "target_entity"),
       ", m AS (SELECT id AS old, first_value(id) OVER (PARTITION BY trim(lower(name)), entity_type ORDER BY ord) AS new FROM ent) SELECT rel.id, a.new AS source_entity, b.new AS target_entity FROM rel JOIN m a ON a.old = source_entity JOIN m b ON b.old = target_entity")
_graph("registry_add_relationships", lambda g: registry.add_relationships(g.rels, g.rels.where("relation_type = 'is-a'").withColumns({"relation_type": F.lit("kind-of"), "ord": F.col("ord") + 1})).select("id", "relation_type"),
       "SELECT id, CASE relation_type WHEN 'is-a' THEN 'kind-of' ELSE relation_type END AS relation_type FROM rel")


@_add("resolve_names", "SELECT 'r:s:' || n_nationkey AS id, 'n' || n_nationkey AS source_entity, 'r' || n_regionkey AS target_entity, 'related_to' AS relation_type, false AS bidirectional, 1.0::DOUBLE AS confidence FROM nation")
def _resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    null = lambda kind: F.lit(None).cast(kind)
    raw = places.select(
        F.lit("s").alias("segment_id"), F.col("n_nationkey").cast("int").alias("place"), F.lower("n_name").alias("source_name"), "r_name", null("string").alias("relation_type"), null("string").alias("context"),
        null("boolean").alias("bidirectional"), null("double").alias("strength"), null("double").alias("confidence"),
    ).withColumnRenamed("r_name", "target_name")
    known = raw_entities(spark, sf_dir).where("entity_type in ('Nation', 'Region')")
    return extract.resolve_names(raw, known).select("id", "source_entity", "target_entity", "relation_type", "bidirectional", "confidence")


@_add("entity_rows", "SELECT 'e:' || item_id || ':0' AS id, left(text, 9) AS name, coalesce(CASE WHEN item_id % 3 = 0 THEN 0.5::DOUBLE END, 1.0::DOUBLE) AS confidence FROM benchmark WHERE item_id % 4 <> 0")
def _entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    raw = rows.select(
        F.col("item_id").cast("string").alias("segment_id"), F.lit(0).alias("place"), F.substring("text", 1, 9).alias("name"), F.when(F.col("item_id") % 4 != 0, "Item").alias("entity_type"),
        F.lit(None).cast("string").alias("context"), F.lit(None).cast("map<string,string>").alias("attributes"), F.when(F.col("item_id") % 3 == 0, 0.5).cast("double").alias("confidence"),
    )
    return extract.entity_rows(raw).select("id", "name", "confidence")


@_add("parse_issues", "SELECT 'kind' || item_id % 3 AS issue_type, CASE item_id % 2 WHEN 0 THEN 'critical' ELSE 'medium' END AS severity, count(*) AS n FROM benchmark WHERE item_id % 5 <> 0 GROUP BY 1, 2")
def _parse_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    body = F.concat(F.lit('found [{"issue_type": "kind'), (F.col("item_id") % 3).cast("string"), F.lit('", "severity": "'), F.when(F.col("item_id") % 2 == 0, "Critical").otherwise("unclear"), F.lit('"}] end'))
    answers = rows.select(F.when(F.col("item_id") % 5 == 0, "no issue").otherwise(body).alias("answer"))
    return verify.parse_issues(answers).groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("n"))


_LINES = lambda d: d.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
_PARAS = f"""WITH para AS (SELECT doc_id::VARCHAR AS doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda x: {_trim('x')}), lambda x: x <> '') AS ps FROM documents)"""
_text("segment_children", lambda d: segment.children(segment.rule_segments(_LINES(d)), "3").select("id", F.md5("text").alias("h")), f"{_PARAS} SELECT '3.' || i AS id, md5(ps[i]) AS h FROM (SELECT ps, unnest(range(1, len(ps) + 1)) AS i FROM para WHERE doc_id = '3')")
_text("segment_parent", lambda d: segment.parent(segment.rule_segments(_LINES(d)), "3.1").select("id", "segment_type"), f"{_PARAS} SELECT doc_id AS id, 'document' AS segment_type FROM para WHERE doc_id = '3' AND len(ps) > 0")
_text("summaries_wanted", lambda d: d.where(F.length(text.strip(F.col("text"))) >= summarize.LEAST_CHARS).select("doc_id"), f"SELECT doc_id FROM documents WHERE length({_trim('text')}) >= 10")


def queries() -> dict[str, Query]:
    """Name to query."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, where SQL can express the query."""
    return dict(_ORACLES)
