"""What makes queries feasible on larger tables, against the plain forms."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from graphwright.operators import conflicts, metrics, traverse
from graphwright.operators.graph import KG
from graphwright.plans import testgraph
from graphwright.schema import entity_frame, relationship_frame
from graphwright.sources import graph_io

DIR = "/root/testdata/sf0.001"


def test_relationships_are_built_without_comparing_all_rows(spark):
    built = testgraph._build_relationships(spark, DIR)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_conditions_with_a_key_give_the_rows_of_the_definition(spark):
    assert all(testgraph.RELATIONSHIPS_SQL.count(condition) == 1 for condition in testgraph.KEYED)
    con = duckdb.connect()
    for t in testgraph.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    definition = testgraph.RELATIONSHIPS_SQL
    for t in testgraph.TABLES:
        definition = definition.replace(f"{{{t}}}", t)
    wanted = con.sql(f"SELECT id, source_entity, target_entity, ord FROM ({definition})").fetchall()
    got = testgraph._build_relationships(spark, DIR).select("id", "source_entity", "target_entity", "ord").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_graphml_of_many_part_files_is_read_whole(spark, tmp_path):
    nodes = [{"id": f"n{i}", "name": f"<{i}>", "type": "T", "ord": i} for i in range(200)]
    kg = KG(entity_frame(spark, nodes), relationship_frame(spark, [{"id": f"r{i}", "source": f"n{i}", "target": f"n{(i + 1) % 200}", "type": "t", "ord": i} for i in range(200)]))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        graph_io.export(kg, str(tmp_path / "parts"), "graphml")
    finally:
        spark.conf.unset(setting)
    assert len(list((tmp_path / "parts").glob("part-*"))) > 1
    again = graph_io.import_graph(spark, str(tmp_path / "parts"), "graphml")
    for a, b in ((kg.nodes, again.nodes), (kg.rels, again.rels)):
        assert sorted(map(str, a.drop("attributes", "metadata").collect())) == sorted(map(str, b.drop("attributes", "metadata").collect()))
    (tmp_path / "other.graphml").write_text('<graphml>\n<graph>\n<node id="a"/><node id="b">\n<data key="label">B</data>\n</node>\n<edge source="a"\n target="b"/></graph></graphml>')
    other = graph_io.import_graph(spark, str(tmp_path / "other.graphml"), "graphml")
    assert sorted(r.id for r in other.entities.collect()) == ["a", "b"]


def test_counts_of_conflicts_are_those_of_the_listed_ones(spark):
    some = random.Random(3)
    nodes = []
    for i in range(150):
        attributes = {k: some.choice(["x", "y", 1]) for k in "abc" if some.random() < 0.6}
        nodes.append({"id": f"n{i}", "name": some.choice(["A", "B", "C"]), "type": some.choice("TU"), "attributes": attributes, "confidence": some.choice([0.4, 0.7, 0.9]), "ord": i})
    rels = [{"id": f"r{i}", "source": f"n{some.randrange(12)}", "target": f"n{some.randrange(12)}", "type": some.choice(["is-a", "is-not-a", "causes", "prevents"]), "confidence": 0.8, "ord": i} for i in range(80)]
    entities = entity_frame(spark, nodes).unionByName(entity_frame(spark, [{"id": "z", "name": "A", "type": "T", "confidence": 0.9}]))
    nulls = F.when(F.col("id").isin("n1", "n2", "n3"), F.expr("map('a', cast(null as string), 'b', '\"x\"')")).otherwise(F.col("attributes"))
    kg = KG(entities.withColumn("attributes", nulls), relationship_frame(spark, rels))
    for least in (0.5, 0.95):
        listed = conflicts.detect_conflicts(kg, least).groupBy("type", "severity").count().collect()
        assert sorted(map(tuple, conflicts.conflict_counts(kg, least).collect())) == sorted(map(tuple, listed))
        assert len(listed) == (3 if least == 0.5 else 0)
    actions = conflicts.resolve_conflicts(kg)[0].groupBy("action_type").count().collect()
    assert sorted(map(tuple, conflicts.action_counts(kg).collect())) == sorted(map(tuple, actions)) and len(actions) == 3


def test_conflicts_of_one_name_are_counted_without_listing_pairs(spark):
    # Twenty thousand million pairs.
    rows = spark.range(200_000).select(
        F.concat(F.lit("n"), "id").alias("id"), F.lit("A").alias("name"), F.lit("T").alias("entity_type"), F.lit(None).cast("string").alias("context"),
        F.create_map(F.lit("k"), (F.col("id") % 4).cast("string")).alias("attributes"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(1.0).alias("confidence"), F.col("id").alias("ord"),
    )
    kg = KG(rows, relationship_frame(spark, []), unique=True)
    assert conflicts.property_conflict_pairs(kg).first()["n"] == 6 * 50_000**2


def test_arcs_are_the_ends_of_edges_without_a_window_and_first_steps_are_not_joined_with_all_levels(spark):
    some = random.Random(4)
    rels = [{"id": f"r{i}", "source": f"n{some.randrange(20)}", "target": f"n{some.randrange(20)}", "type": "t", "bidirectional": i % 3 == 0, "ord": i} for i in range(40)]
    kg = KG(entity_frame(spark, [{"id": f"n{i}", "name": f"n{i}", "type": "T", "ord": i} for i in range(22)]), relationship_frame(spark, rels))
    pairs = {(r.s, r.t) for r in kg.edges.select("s", "t").collect()}
    assert sorted(map(tuple, kg.arcs.collect())) == sorted(pairs) and "Window" not in kg.arcs._jdf.queryExecution().executedPlan().toString()
    hops = {(f"n{i}", f"n{i}"): 0 for i in range(22)}
    for n in range(1, 22):
        for (a, b), k in list(hops.items()):
            for s, t in pairs if k == n - 1 else ():
                if s == b:
                    hops.setdefault((a, t), n)
    assert {(r.source, r.id): r.hops for r in metrics.distances(kg).collect()} == hops


def test_cycles_are_sought_only_where_a_way_leads_back(spark, monkeypatch):
    rows = [("k", f"c{i:03}", "hub") for i in range(100)] + [("k", "hub", "top"), ("k", "top", "hub"), ("k", "top", "out"), ("q", "hub", "c001")]
    seen, plain = [], traverse.find_cycles
    monkeypatch.setattr(traverse, "find_cycles", lambda edges, *more: seen.append(edges.count()) or plain(edges, *more))
    found = traverse.all_cycles(spark.createDataFrame(rows, "kind string, s string, t string"), 4).collect()
    assert [(r.kind, r.start, r.nodes, r.length) for r in found] == [("k", "hub", ["hub", "top"], 2)] and seen == [2]
