"""Pairs of entities made from units of equal values, against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphwright.operators import conflicts, coref
from graphwright.operators.graph import KG
from graphwright.plans import registry, testgraph
from graphwright.schema import entity_frame, relationship_frame


def test_conflicts_of_units_are_all_pairs_that_differ(spark, monkeypatch):
    monkeypatch.setattr(conflicts, "UNIT", 3)
    some = random.Random(8)
    rows = []
    for i in range(120):
        attributes = {k: some.choice(["x", "y", 1]) for k in "abc" if some.random() < 0.7} | {"same": 1}
        rows.append({"id": f"e{i:03}", "name": some.choice("AB"), "type": some.choice("TU"), "attributes": attributes, "confidence": some.choice([0.4, 0.7, 0.9]), "ord": some.randrange(60)})
    nodes = entity_frame(spark, rows).withColumn("attributes", F.when(F.col("id") == "e001", F.expr("map('a', cast(null as string), 'b', '\"x\"')")).otherwise(F.col("attributes")))
    sure = [r for r in nodes.collect() if r.confidence >= 0.5]
    wanted = []
    for a in sure:
        for b in sure:
            if (a.ord, a.id) < (b.ord, b.id) and (a["name"], a.entity_type) == (b["name"], b.entity_type):
                for k in set(a.attributes) & set(b.attributes):
                    if None not in (a.attributes[k], b.attributes[k]) and a.attributes[k] != b.attributes[k]:
                        wanted.append((a.id, b.id, a["name"], a.entity_type, k, a.attributes[k], b.attributes[k], "medium", min(a.confidence, b.confidence), a.confidence, b.confidence, a.ord, b.ord))
    got = conflicts.property_conflicts(KG(nodes, relationship_frame(spark, []), unique=True)).collect()
    assert len(wanted) > 500 and sorted(map(tuple, got)) == sorted(wanted)


@pytest.mark.parametrize("name", ["conflict_property", "coref_groups"])
def test_queries_of_entities_build_no_relationships(spark, monkeypatch, name):
    monkeypatch.setattr(testgraph, "_LOADED", {})
    monkeypatch.setattr(testgraph, "_build_relationships", lambda *_: pytest.fail("built"))
    registry.queries()[name](spark, "/root/testdata/sf0.001")


def test_groups_without_merging_are_those_of_resolving(spark):
    some = random.Random(9)
    rows = [{"id": f"e{i:02}", "name": some.choice(["anna lee", "ana lee", "bob", "bobb", "x"]), "type": some.choice("PQ"), "confidence": some.choice([0.5, 0.9]), "ord": i} for i in range(30)]
    kg = KG(entity_frame(spark, rows), relationship_frame(spark, []))
    whole = coref.resolve(kg)[1]
    assert coref.resolved_groups(kg).columns == whole.columns and sorted(map(str, coref.resolved_groups(kg).collect())) == sorted(map(str, whole.collect()))
    names = spark.createDataFrame([("abc", None), (None, "abc"), ("", ""), ("abc", "abd")], "a string, b string")
    assert [r[0] for r in names.select(coref.name_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 1.0, 4 / 6]
