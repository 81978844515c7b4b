from __future__ import annotations

import pytest
from fixtures import jobs, rel

from graphwright import KG
from graphwright.operators import conflicts, reason, traverse, verify
from graphwright.schema import entity_frame, relationship_frame


def pairs(df):
    return {(r.relation_type, r.source_entity, r.target_entity, round(r.confidence, 6)) for r in df.collect()}


def test_chained(spark):
    assert pairs(reason.infer_chained(jobs(spark), 0.6)) == {("qualified-for", "person1", "job1", 0.648)}
    assert pairs(reason.infer_chained(jobs(spark), 0.7)) == set()


def test_all_inferences_of_the_base(spark):
    assert pairs(reason.infer_new_relationships(jobs(spark))) == {("employs", "company1", "person1", 0.855)}


def test_symmetric_is_idempotent(spark):
    kg = jobs(spark, [rel("sim", "person1", "person2", "similar-to")])
    found = reason.infer_symmetric(kg)
    assert pairs(found) == {("similar-to", "person2", "person1", 0.855)}
    more = kg.add_relationships(relationship_frame(spark, [rel("sim2", "person2", "person1", "similar-to")]))
    assert reason.infer_symmetric(more).count() == 0


def test_inverse_accepts_underscores(spark):
    kg = jobs(spark, [rel("c", "company1", "person1", "contains"), rel("p", "job1", "company1", "part_of")])
    assert ("part-of", "person1", "company1", 0.855) in pairs(reason.infer_inverse(kg))
    assert ("contains", "company1", "job1", 0.855) in pairs(reason.infer_inverse(kg))
    assert ("contains", "company1", "job1", 0.855) not in pairs(reason.infer_inverse(kg, strict=True))


def test_transitive(spark):
    nodes = entity_frame(spark, [{"id": x, "name": x, "type": "t"} for x in "abcd"])
    rels = [rel("1", "a", "b", "is-a", 1.0), rel("2", "b", "c", "is-a", 1.0), rel("3", "c", "d", "is-a", 1.0), rel("4", "a", "d", "is-a", 0.1)]
    assert pairs(reason.infer_transitive(KG(nodes, relationship_frame(spark, rels)))) == {("is-a", "a", "c", 0.81), ("is-a", "b", "d", 0.81)}


def test_path_inference(spark):
    kg = jobs(spark)
    steps = traverse.path_steps(kg, traverse.find_paths(kg, "person1", "job1", relationship_types=["has-skill", "required-for"]))
    rows = reason.path_inferences(steps).collect()
    assert [(r.relation_type, r.source_entity, r.target_entity, round(r.confidence, 6)) for r in rows] == [("qualified-for", "person1", "job1", 0.72)]


def test_contradictions(spark):
    kg = jobs(spark, [rel("c1", "person1", "company1", "works-for", 0.9), rel("c2", "person1", "company1", "not-affiliated-with", 0.7)])
    assert conflicts.contradictions(kg).count() == 4 and kg.rels.count() == 7
    assert {r.id for r in conflicts.resolve_contradictions(kg).rels.collect()} == {"knows", "works", "skilled", "required", "offers", "c1"}


def test_property_conflicts(spark):
    two = [{"id": f"x{i}", "name": "ConflictEntity", "type": "test", "attributes": {"size": s, "color": "red"}, "confidence": c} for i, (s, c) in enumerate([("large", 0.8), ("small", 0.7)])]
    kg = jobs(spark, nodes=two)
    assert [(r.id1, r.id2, r.key) for r in conflicts.property_conflicts(kg).collect()] == [("x0", "x1", "size")]
    fixed = {r.id: r.attributes for r in conflicts.resolve_property_conflicts(kg).nodes.collect()}
    assert fixed["x1"] == {"size": '"large"', "color": '"red"'} and fixed["person1"] == {"age": "30"}


def test_cycles(spark):
    ring = [rel(f"y{i}", f"entity{i}", f"entity{i % 3 + 1}", "is-a", 0.8 - i / 100) for i in (1, 2, 3)]
    kg = jobs(spark, ring)
    assert [(r.start, list(r.nodes), r.length) for r in conflicts.circular_hierarchies(kg).collect()] == [("entity1", ["entity1", "entity2", "entity3"], 3)]
    assert "y3" not in {r.id for r in conflicts.resolve_cycles(kg).rels.collect()}
    actions, out = conflicts.resolve_conflicts(kg)
    assert [(r.action_type, r.removed) for r in actions.collect()] == [("break_cycle", "y3")] and out.rels.count() == 7
    assert {r.type for r in conflicts.detect_conflicts(kg).collect()} == {"circular_hierarchy"}


def _check(spark, names, rels):
    nodes = entity_frame(spark, [{"id": x, "name": x, "type": "Concept"} for x in names])
    found: dict[str, int] = {}
    for r in verify.verify(nodes, relationship_frame(spark, rels)).collect():
        found[r.issue_type] = found.get(r.issue_type, 0) + 1
    return found


def test_verification(spark):
    assert _check(spark, ["ml", "dl", "rl", "ai", "nn"], [rel("1", "ml", "ai", "is-a"), rel("2", "dl", "ml", "is-a"), rel("3", "rl", "ml", "is-a"), rel("4", "dl", "nn", "uses")]) == {}
    mixed = [rel("1", "ml", "ai", "is-a"), rel("2", "ai", "ml", "is-a"), rel("3", "dl", "ml", "is-a"), rel("4", "dl", "ml", "is-not-a"), rel("5", "nn", "ai", "part-of"), rel("6", "nn", "ai", "separate-from")]
    assert _check(spark, ["ml", "dl", "ai", "nn"], mixed) == {"cyclic_dependency": 1, "contradictory_relationships": 2}
    assert _check(spark, "abcd", [rel("1", "a", "b", "part-of"), rel("2", "b", "c", "part-of"), rel("3", "c", "a", "part-of"), rel("4", "d", "a", "part-of")]) == {"cyclic_dependency": 1}
    assert _check(spark, "ab", [rel("1", "a", "b", "x"), rel("2", "a", "gone", "x"), rel("3", "gone", "b", "x")]) == {"dangling_reference": 2}
    assert _check(spark, "abc", [rel("1", "a", "b", "is-a"), rel("2", "b", "c", "is-a"), rel("3", "a", "c", "different-from")])["transitive_contradiction"] == 1


def test_issue_parsing(spark):
    answers = spark.createDataFrame([('x [{"issue_type": "a", "severity": "HIGH"}, {"severity": "low"}] y',), ('{"issue_type": "b", "severity": "Critical", "involved_elements": ["r"]}',), ("nothing",)], "answer string")
    issues = verify.parse_issues(answers)
    assert {(r.issue_type, r.severity) for r in issues.collect()} == {("a", "medium"), ("b", "critical")}
    assert verify.is_valid(issues).first().is_valid is False


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(spark, parts):
    kg = jobs(spark, [rel("sim", "person1", "person2", "similar-to")])
    moved = KG(kg.entities.repartition(parts), kg.relationships.repartition(parts))
    assert pairs(reason.infer_new_relationships(moved, 0.6)) == pairs(reason.infer_new_relationships(kg, 0.6))
