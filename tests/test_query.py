from __future__ import annotations

import pytest
from fixtures import rel, team

from graphwright import KG
from graphwright.operators import metrics, query, traverse
from graphwright.schema import entity_frame, relationship_frame, validate_entities, validate_relationships


def ids(df):
    return {r[0] for r in df.select("id").collect()}


def test_entity_predicates(spark):
    kg = team(spark)
    assert ids(query.find_entities(kg, {"type": "person"})) == {"alice", "bob"}
    assert ids(query.find_entities(kg, {"attributes": {"age": "30"}})) == {"alice"}
    assert ids(query.find_entities(kg, {"attributes": {"age": 30}})) == set()
    assert ids(query.find_entities(kg, {"type": "person", "role": "engineer"})) == {"bob"}
    assert ids(query.find_entities(kg, {"role": "engineer"})) == {"bob", "company_x", "city_a", "project_y"}
    assert ids(query.find_entities(kg, {"name": {"contains": "A"}})) == {"alice", "city_a"}
    assert ids(query.find_entities(kg, {"name": {"regex": "^.o"}})) == {"bob", "company_x"}
    assert [r.id for r in query.find_entities(kg, {}, 2).collect()] == ["alice", "bob"]


def test_relationship_predicates(spark):
    kg = team(spark)
    assert len(ids(query.find_relationships(kg, {"type": "works_at"}))) == 2
    assert len(ids(query.find_relationships(kg, {"source": "alice"}))) == 2
    assert len(ids(query.find_relationships(kg, {"target": "company_x"}))) == 2
    assert ids(query.find_relationships(kg, {"confidence": {"min": 0.95}})) == set()


def test_search(spark):
    kg = team(spark)
    assert ids(query.search_text(kg, "engineer")[0]) == {"bob"}
    assert ids(query.search_text(kg, "ALICE")[0]) == {"alice"}
    assert ids(query.search_text(kg, "ALICE", case_sensitive=True)[0]) == set()
    listed = KG(entity_frame(spark, [{"id": "x", "name": "X", "type": "t", "attributes": {"tags": ["red fox", 3], "n": 42}}]), relationship_frame(spark, []))
    assert ids(query.search_text(listed, "FOX")[0]) == {"x"}
    assert ids(query.search_text(listed, "42")[0]) == set()


def test_subgraph_and_confidence(spark):
    kg = team(spark)
    one, two = query.subgraph(kg, ["alice"]), query.subgraph(kg, ["alice", "bob"])
    assert (one.nodes.count(), one.rels.count(), two.nodes.count(), two.rels.count()) == (1, 0, 2, 0)
    near = query.subgraph(kg, ["alice"], include_neighbors=True)
    assert ids(near.nodes) == {"alice", "company_x", "city_a"} and ids(near.rels) == {"aw", "al", "xl"}
    weak = team(spark, {"alice": 0.8, "bob": 0.3, "*nodes": 0.4, "aw": 0.9, "*rels": 0.4})
    assert query.filter_by_confidence(weak, 0.5, "entities").nodes.count() == 1
    assert query.filter_by_confidence(weak, 0.5, "relationships").rels.count() == 1
    both = query.filter_by_confidence(weak, 0.5)
    assert (both.nodes.count(), both.rels.count()) == (1, 0)


def test_traverse_and_paths(spark):
    kg = team(spark)
    assert {r.node for r in traverse.traverse(kg, "alice", 1).collect()} == {"alice", "company_x", "city_a"}
    assert {r.node for r in traverse.traverse(kg, "alice", 1, relationship_types=["works_at"]).collect()} == {"alice", "company_x"}
    assert {r.node for r in traverse.traverse(kg, "alice", 1, entity_types=["organization"]).collect()} == {"alice", "company_x"}
    assert traverse.traverse(kg, "nobody").count() == 0
    tree = traverse.traverse_dfs(kg, "alice", 2)
    assert [c["child"]["entity"] for c in tree["children"]] == ["company_x"] or len(tree["children"]) == 2
    paths = traverse.find_paths(kg, "alice", "project_y").collect()
    assert [list(p.nodes) for p in paths] == [["alice", "company_x", "project_y"]] and list(paths[0].rel_ids) == ["aw", "xy"]
    assert traverse.find_paths(kg, "alice", "project_y", max_depth=1).count() == 0
    assert [list(p.nodes) for p in traverse.find_paths(kg, "bob", "bob").collect()] == [["bob"]]


def test_degree_and_components(spark):
    kg = team(spark)
    scores = {r.id: r.score for r in metrics.degree_centrality(kg).collect()}
    assert scores == {"company_x": 1.0, "alice": 0.5, "bob": 0.5, "city_a": 0.5, "project_y": 0.5}
    more = kg.add_entities(entity_frame(spark, [{"id": "charlie", "name": "Charlie", "type": "person"}, {"id": "company_z", "name": "Z", "type": "organization"}]))
    more = more.add_relationships(relationship_frame(spark, [rel("cz", "charlie", "company_z", "works_at"), rel("lost", "charlie", "nowhere", "works_at")]))
    groups: dict[str, int] = {}
    for r in metrics.components(more).collect():
        groups[r.component] = groups.get(r.component, 0) + 1
    assert sorted(groups.values()) == [2, 5] and "lost" not in ids(more.rels)


def test_long_chain_is_one_component(spark):
    n = 300
    nodes = entity_frame(spark, [{"id": f"n{i:04d}", "name": "x", "type": "t"} for i in range(n)])
    rels = relationship_frame(spark, [rel(f"r{i}", f"n{i:04d}", f"n{i + 1:04d}", "next") for i in range(n - 1)])
    found = metrics.components(KG(nodes, rels)).collect()
    assert {r.component for r in found} == {"n0000"} and len(found) == n


def test_edges_collapse_and_reverse(spark):
    nodes = entity_frame(spark, [{"id": x, "name": x, "type": "t"} for x in "ab"])
    rels = relationship_frame(spark, [rel("r1", "a", "b", "x"), rel("r2", "a", "b", "y", bidirectional=True)])
    kg = KG(nodes, rels)
    assert {(r.id, r.s, r.t) for r in kg.edges.collect()} == {("r2", "a", "b"), ("r2_reverse", "b", "a")} and kg.rels.count() == 2


def test_changes(spark):
    kg = team(spark)
    assert ids(kg.remove_entities(["company_x"]).rels) == {"al", "by"}
    merged = kg.merge_entities(["alice", "bob"], entity_frame(spark, [{"id": "both", "name": "Both", "type": "person"}]))
    assert ids(merged.nodes) == {"both", "company_x", "city_a", "project_y"}
    assert {(r.source_entity, r.target_entity) for r in merged.rels.collect()} >= {("both", "company_x"), ("both", "city_a")}


def test_validation(spark):
    good, bad = validate_entities(entity_frame(spark, [{"id": "a", "name": "A", "type": "t"}, {"id": "b", "name": "", "type": "t"}, {"id": "c", "name": "C", "type": "t", "confidence": 2}]))
    assert ids(good) == {"a"} and {r.reason for r in bad.collect()} == {"empty name", "confidence outside [0, 1]"}
    good, bad = validate_relationships(relationship_frame(spark, [rel("r", "a", "b", "x"), rel("s", "", "b", "x"), rel("t", "a", "b", "x", strength=-1)]))
    assert ids(good) == {"r"} and bad.count() == 2


@pytest.mark.parametrize("metric", ["degree", "closeness", "betweenness", "pagerank", "unknown"])
def test_sorting_by_metric(spark, metric):
    rows = metrics.sort_by_metric(team(spark), metric, 2).collect()
    assert len(rows) == 2 and rows[0].score >= rows[1].score


def test_eigenvector_needs_cycles(spark):
    with pytest.raises(ArithmeticError):
        metrics.eigenvector(team(spark), rounds=5)
    ring = KG(entity_frame(spark, [{"id": x, "name": x, "type": "t"} for x in "abc"]), relationship_frame(spark, [rel(x + y, x, y, "n") for x, y in ("ab", "bc", "ca")]))
    assert {round(r.score, 6) for r in metrics.eigenvector(ring).collect()} == {round(3**-0.5, 6)}
