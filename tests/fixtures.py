"""Small graphs with known answers."""

from __future__ import annotations

from graphwright import KG
from graphwright.schema import entity_frame, relationship_frame


def _rel(id_, source, target, kind, confidence=0.9, **more):
    return {"id": id_, "source": source, "target": target, "type": kind, "confidence": confidence, **more}


def team(spark, confidences: dict | None = None) -> KG:
    """People, a company, a city and a project."""
    c = confidences or {}
    nodes = [
        {"id": "alice", "name": "Alice", "type": "person", "attributes": {"age": "30", "role": "manager"}},
        {"id": "bob", "name": "Bob", "type": "person", "attributes": {"age": "25", "role": "engineer"}},
        {"id": "company_x", "name": "Company X", "type": "organization", "attributes": {"industry": "tech"}},
        {"id": "city_a", "name": "City A", "type": "location", "attributes": {"country": "USA"}},
        {"id": "project_y", "name": "Project Y", "type": "project", "attributes": {"status": "active"}},
    ]
    rels = [
        _rel("aw", "alice", "company_x", "works_at"), _rel("bw", "bob", "company_x", "works_at"), _rel("al", "alice", "city_a", "lives_in"),
        _rel("xl", "company_x", "city_a", "located_in"), _rel("by", "bob", "project_y", "works_on"), _rel("xy", "company_x", "project_y", "develops"),
    ]
    for row in nodes + rels:
        row["confidence"] = c.get(row["id"], c.get("*nodes" if "name" in row else "*rels", 0.9))
    return KG(entity_frame(spark, nodes), relationship_frame(spark, rels))


def jobs(spark, extra: list | None = None, nodes: list | None = None) -> KG:
    """A person with a skill that a job needs."""
    base = [("person1", "John Doe", "Person", {"age": 30}), ("person2", "Jane Smith", "Person", {"age": 35}), ("company1", "Acme Corp", "Organization", {"industry": "Tech"}),
            ("skill1", "Programming", "Skill", {}), ("job1", "Software Developer", "Job", {}), ("entity1", "E1", "Test", {}), ("entity2", "E2", "Test", {}), ("entity3", "E3", "Test", {})]
    rows = [{"id": i, "name": n, "type": t, "attributes": a, "confidence": 0.9} for i, n, t, a in base] + (nodes or [])
    rels = [_rel("knows", "person1", "person2", "knows", 0.8), _rel("works", "person1", "company1", "works-for"), _rel("skilled", "person1", "skill1", "has-skill"),
            _rel("required", "skill1", "job1", "required-for", 0.8), _rel("offers", "company1", "job1", "offers", 0.7)]
    return KG(entity_frame(spark, rows), relationship_frame(spark, rels + (extra or [])))


rel = _rel
