from __future__ import annotations

import json

import pytest
from fixtures import rel, team
from pyspark.sql import functions as F

from graphwright import KG
from graphwright.functions import language, text
from graphwright.operators import coref, extract, registry, segment, summarize, viz
from graphwright.operators.provider import ScriptedProvider, get_provider
from graphwright.plans.config import Config, Timer
from graphwright.plans.pipeline import extract_knowledge, write_artifacts
from graphwright.plans.result import Result, collect_results
from graphwright.schema import entity_frame, relationship_frame
from graphwright.sources import graph_io, loader
from graphwright.sources.store import GraphStore
from graphwright.streaming import upsert


def entity(id_, name, kind, **more):
    return {"id": id_, "name": name, "type": kind, **more}


def test_registry_merges(spark):
    rows = [
        entity("1", "Knowledge Graph", "Concept", confidence=0.8, context="one", attributes={"k": "a", "l": ["x", "y"]}, metadata={"m": 1}),
        entity("2", " knowledge graph", "Concept", confidence=0.9, context="two", attributes={"k": "b", "l": ["y", "z"], "n": 3}, metadata={"m": 2}),
        entity("3", "Python", "Language"), entity("4", "Python", "Animal"), entity("3", "Python", "Language", context="again"),
    ]
    out = {r.id: r for r in registry.deduplicate(entity_frame(spark, rows)).collect()}
    assert set(out) == {"1", "3", "4"}
    one = out["1"]
    assert (one.name, one.confidence, one.context) == (" knowledge graph", 0.9, "one\ntwo") and one.metadata == {"m": "1"}
    assert {k: json.loads(v) for k, v in one.attributes.items()} == {"k": ["a", "b"], "l": ["x", "y", "z"], "n": 3}
    again = {r.id: r for r in registry.deduplicate_parity(entity_frame(spark, rows)).collect()}
    assert json.loads(again["1"].attributes["k"]) == ["a", "b"] and again["1"].name == " knowledge graph"
    assert {(r.old_id, r.new_id) for r in registry.id_map(entity_frame(spark, rows)).collect()} == {("1", "1"), ("2", "1"), ("3", "3"), ("4", "4")}


def test_merge_does_not_depend_on_partitions(spark):
    rows = entity_frame(spark, [entity(str(i), f"N{i % 3}", "t", confidence=(i * 7 % 10) / 10, context=f"c{i % 4}", attributes={"a": i % 2}) for i in range(40)])
    a, b = (sorted(map(str, registry.deduplicate(rows.repartition(n)).collect())) for n in (1, 7))
    assert a == b


def test_coreference(spark):
    rows = [entity("1", "Neural Network", "C", confidence=0.7), entity("2", "Neural Networks", "C", confidence=0.9), entity("3", "Neural Nets", "C"), entity("4", "Graph", "C"), entity("5", "Neural Network", "Other")]
    kg = KG(entity_frame(spark, rows), relationship_frame(spark, [rel("r", "2", "4", "uses")]))
    out, groups, mapping = coref.resolve(kg, 0.7)
    assert {tuple(r.entity_ids) for r in groups.collect()} == {("1", "2", "3")}
    assert {r.old_id: r.new_id for r in mapping.collect()}["2"] == "1"
    assert {(r.source_entity, r.target_entity) for r in out.rels.collect()} == {("1", "4")}
    kept = spark.createDataFrame([("1", False, "x", 0.5)], "center string, merge_decision boolean, canonical_name string, confidence double")
    assert coref.resolve(kg, 0.7, decisions=kept)[0].nodes.count() == 5
    assert {(r.id1, r.id2) for r in coref.similar_pairs(kg.nodes, 0.9, "edit").collect()} == {("1", "2")}


def test_star_groups_are_greedy(spark):
    pairs = spark.createDataFrame([("a", "b", 0, 1, 1.0), ("b", "c", 1, 2, 1.0), ("c", "d", 2, 3, 1.0)], "id1 string, id2 string, ord1 long, ord2 long, similarity double")
    assert {(r.id, r.center) for r in coref.star_groups(pairs).collect()} == {("b", "a"), ("d", "c")}


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, "a\r\nb\r\r\r\rc  \t d \n", text.normalize_text) == "a\nb\n\nc d"
    assert one(spark, " a​ \n b﻿ ", text.normalize_loaded) == "a b"
    assert one(spark, "p1\n\n\n p2 \n\nq", text.paragraphs) == ["p1", "p2", "q"]
    assert one(spark, "hello big world", lambda c: text.truncate(c, 9)) == "hello..."
    assert one(spark, " helloworld", lambda c: text.truncate(c, 5)) == " hell..."
    assert one(spark, "abcdefghij", lambda c: text.truncate(c, 5, False)) == "abcde"
    assert [one(spark, v, text.approximate_tokens) for v in ("", "  ", "abcdefgh", None)] == [0, 1, 2, 0]
    assert one(spark, "# T\n**b** *i* `c` [l](u) ![a](b)\n---\n- x\n1. y", text.strip_markdown) == "T\nb i c l !a\nx\ny"
    assert one(spark, "This is plain text. It has words.", text.is_natural_language) is True
    assert [one(spark, v, text.is_natural_language) for v in ("short", "x = 1 and so on", "no capital letters here at all", None)] == [False] * 4
    assert one(spark, "a " * 100 + "End. " + "b " * 100, lambda c: text.best_split_point(c, 200)) == 205
    packed = one(spark, "\n\n".join(["a" * 40, "b" * 40, "c" * 10]), lambda c: text.pack_paragraphs(c, 90))
    assert [(p.id, p.position, p.length) for p in packed] == [("seg_1", 0, 82), ("seg_2", 12, 10)]
    assert one(spark, 'say {"a": {"b": 1}} ok', text.outermost_json) == '{"a": {"b": 1}}'


def test_languages(spark):
    assert one(spark, "RU", language.language_name) == "Русский" and one(spark, "xx", language.language_name) == "xx"
    assert [one(spark, v, language.closest_supported) for v in ("EN", "uk", "de", "UK", "zz")] == ["EN", "ru", "en", "en", "en"]
    for value, code in (("Это просто текст на русском языке и он не очень длинный", "ru"), ("the cat is on the table and it was not there", "en"), ("der Hund und die Katze sind nicht auf dem Tisch", "de")):
        assert one(spark, value, language.detect_language) == code
    assert one(spark, "  ", language.detect_language) is None
    assert language.prompt_for({"en": {"k": "hello"}, "ru": {}}, "k", "RU") == "hello"


def test_segments(spark):
    body = "First paragraph.\n\n" + "A long sentence with words. " * 8 + "Last one!\n \n\n  End"
    segments = segment.rule_segments(spark.createDataFrame([("d", body), ("e", None)], "doc_id string, text string"))
    rows = {r.id: r for r in segments.collect()}
    assert rows["d"].children_ids == ["d.1", "d.2", "d.3"] and rows["e"].children_ids == [] and len(rows["d.2"].children_ids) == 9
    assert all(body[r.start : r.end] == r.text for r in rows.values() if r.doc_id == "d")
    assert [r.id for r in segment.children(segments, "d").collect()] == ["d.1", "d.2", "d.3"]
    assert segment.parent(segments, "d.2.1").first().id == "d.2"
    assert {r.id: (r.depth, r.path) for r in segment.hierarchy(segments).collect()}["d.2.1"] == (2, "d/d.2/d.2.1")
    tree = json.loads(segment.tree_json(segments, "d"))
    assert len(tree) == 1 and len(tree[0]["children"]) == 3
    parsed = segment.parse_segments(spark, [("x", 'ok {"segments": [{"type": "section", "text": "a", "segments": [{"text": "b"}]}]}'), ("y", "broken")])
    assert {(r.id, r.parent_id, r.level) for r in parsed.collect()} == {("x.1", None, 0), ("x.1.1", "x.1", 1)}


def test_summaries_use_the_cache(spark):
    rows = spark.createDataFrame([("1", "A text that is long enough.", "p"), ("2", "A text that is long enough.", "p"), ("3", "tiny", "p")], "id string, text string, segment_type string")
    out, cache = summarize.summarize(rows)
    assert {r.segment_id for r in out.collect()} == {"1", "2"} and cache.count() == 1

    def fail(prompt, schema):
        raise AssertionError("the cache was not used")

    again, _ = summarize.summarize(rows, cache, lambda: ScriptedProvider(fail))
    assert again.count() == 2


def test_extraction(spark):
    answers = {
        "entities": {"entities": [{"name": "Ada", "type": "Person", "role": "author", "attributes": "x", "context": "Ada wrote notes"}, {"name": "", "type": "Person"}, {"name": "Notes", "type": "Work"}]},
        "relationships": {"relationships": [{"source": "ADA", "target": "notes"}, {"source": "Ada", "target": "unknown"}]},
    }
    rows = spark.createDataFrame([("s1", "Indeed Ada wrote notes once.", "paragraph", 1, None)], "id string, text string, segment_type string, level int, title string")
    kg = extract.extract_graph(rows, lambda: ScriptedProvider(lambda prompt, schema: answers[schema["task"]]))
    nodes = {r.name: r for r in kg.nodes.collect()}
    assert set(nodes) == {"Ada", "Notes"} and nodes["Ada"].attributes == {"value": '"x"', "role": '"author"'} and nodes["Ada"].metadata["segment_type"] == "paragraph"
    found = kg.rels.collect()
    assert [(r.relation_type, r.confidence, r.bidirectional) for r in found] == [("related_to", 1.0, False)]
    with pytest.raises(ValueError):
        get_provider("nothing")


def test_contexts_meet_whole_texts(spark):
    texts = spark.createDataFrame([("t1", "xx some long quotation of many characters yy"), ("t2", "tiny bit here"), ("t3", None)], "id string, text string")
    quotes = entity_frame(spark, [entity("q1", "Q", "t", context="long quotation of many characters\nabsent"), entity("q2", "R", "t", context="tiny bit"), entity("q3", "S", "t", context="tiny bits")])
    assert {(r.segment_id, r.entity_id) for r in extract.entities_in_segments(texts, quotes).collect()} == {("t1", "q1"), ("t2", "q2")}


def test_store_and_forms(spark, tmp_path):
    kg, store = team(spark), GraphStore(spark, str(tmp_path / "store"))
    first = store.save(kg, "my graph")
    more = kg.add_entities(entity_frame(spark, [entity("new", "New", "person")]))
    second = store.save(more, "my graph", "with one more")
    assert store.load("my graph").nodes.count() == 6 and store.load("my graph", first).nodes.count() == 5
    assert [r.version_id for r in store.list_versions("my graph").collect()] == [second, first]
    store.describe("my graph", first, "the first")
    assert {r.version_id: r.description for r in store.list_versions("my graph").collect()} == {first: "the first", second: "with one more"}
    listed = store.list_graphs().first()
    assert (listed.graph, listed.versions, listed.entity_count) == ("my_graph", 2, 6)
    with pytest.raises(FileNotFoundError):
        store.load("other")
    with pytest.raises(KeyError):
        store.describe("my graph", "none", "x")
    assert store.delete("my graph") and not store.delete("my graph") and store.list_graphs().count() == 0

    for kind in ("json", "graphml", "cypher"):
        graph_io.export(kg, str(tmp_path / kind), kind)
    back = graph_io.import_graph(spark, str(tmp_path / "json"), "jsonl")
    assert (back.nodes.count(), back.rels.count()) == (5, 6)
    lines = [r.value for r in spark.read.text(str(tmp_path / "graphml")).collect()]
    (tmp_path / "one.graphml").write_text("\n".join(lines))
    again = graph_io.import_graph(spark, str(tmp_path / "one.graphml"), "graphml")
    assert {r.id: r.attributes for r in again.nodes.collect()}["alice"] == {"age": '"30"', "role": '"manager"'} and again.rels.count() == 6
    (tmp_path / "g.json").write_text(graph_io.to_json(kg))
    nested = graph_io.read_json(spark, str(tmp_path / "g.json"))
    assert nested.name == "knowledge_graph" and nested.rels.count() == 6
    cypher = [r.line for r in graph_io.cypher_lines(kg).orderBy("part", "ord").collect()]
    assert len(cypher) == 12 and cypher[1] == "CREATE (e:person {id: 'alice', name: 'Alice', confidence: 0.9, age: '30', role: 'manager'})"
    with pytest.raises(ValueError):
        graph_io.export(kg, str(tmp_path / "x"), "pdf")
    made = graph_io.from_extraction(spark, {"entities": [{"name": "A", "type": "t"}], "relationships": []}, "science")
    assert made.name == "science_knowledge_graph" and made.nodes.first().id == "e0"


def test_styles(spark):
    kg = team(spark)
    label = {r.id: r for r in viz.node_styles(kg).collect()}["alice"]
    assert label.label == "Alice<br><i>person</i><br>age: 30<br>role: manager<br>confidence: 0.90" and (label.shape, label.size) == ("box", 30)
    assert {r.width for r in viz.edge_styles(kg).collect()} == {4.6}
    assert viz.filtered(kg, ["person", "organization"]).rels.count() == 2
    assert "<svg" in viz.to_html(kg) and "Company X" in viz.subgraph_html(kg, ["alice"]) and "Project Y" in viz.path_html(kg, "alice", "project_y")
    with pytest.raises(ValueError):
        viz.to_html(kg, most=3)


def test_loader(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Привет, мир и всё".encode("windows-1251"))
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfhello the world")
    (tmp_path / "c.txt").write_bytes(b"")
    rows = {r.path.split("/")[-1]: r for r in loader.load_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.txt"} and rows["a.txt"].text == "Привет, мир и всё" and rows["b.txt"].text == "hello the world"
    done = loader.process(loader.load_texts(spark, ["the  cat is\non the mat", ""])).collect()
    assert [(r.normalized, r.language, r.supported) for r in done] == [("the cat is on the mat", "en", True)]


def test_pipeline_runs_end_to_end(spark, tmp_path):
    body = "Yesterday the engineer Ada Lovelace met Charles Babbage in London.\n\nThe machine of Charles Babbage was admired by Ada Lovelace."
    result = extract_knowledge(spark.createDataFrame([("d1", body)], "doc_id string, text string"))
    assert {"Ada Lovelace", "Charles Babbage"} <= {r.name for r in result.graph.nodes.collect()} and result.graph.rels.count() > 0
    assert "dangling_reference" not in {r.issue_type for r in result.issues.collect()}
    write_artifacts(result, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/entities")).count() == result.graph.nodes.count()
    assert set(result.seconds) == {"text", "extraction", "coreference", "verification"}


def test_streaming_upserts(spark, tmp_path):
    rows = entity_frame(spark, [entity("a", "old", "t"), entity("b", "b", "t")])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for turn, name in enumerate(["old", "new"]):
        if turn:
            entity_frame(spark, [entity("a", name, "t")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = upsert.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.processAllAvailable()
        query.stop()
    assert {r.id: r.name for r in upsert.current(spark.read.parquet(str(tmp_path / "out"))).collect()} == {"a": "new", "b": "b"}


def test_values_and_settings(monkeypatch):
    assert Result.ok(2).map(lambda x: x + 1).unwrap() == 3 and Result.fail("e").unwrap_or(1) == 1
    assert collect_results([Result.ok(1), Result.fail("no")]).error == "no" and Result.of(lambda: 1 / 0).success is False
    monkeypatch.setenv("GRAPHWRIGHT_LANGUAGE", "ru")
    assert Config.from_env().language == "ru" and Config(provider="x").problems() and not Config().problems()
    timer = Timer()
    timer.timed(lambda: None)()
    assert list(timer.seconds.values())[0] >= 0


def test_model_passes(spark):
    from graphwright.operators import reason, verify
    from graphwright.plans.demo import sample_graph

    answer = {"segments": [{"type": "section", "text": "a", "segments": [{"text": "b", "position": {"start": 1, "end": 2}}]}]}
    rows = segment.segment_text(spark.createDataFrame([(1, "x")], "doc_id long, text string"), lambda: ScriptedProvider(lambda p, s: answer)).collect()
    assert {(r.id, r.parent_id, r.start) for r in rows} == {("1.1", None, None), ("1.1.1", "1.1", 1)}
    kg = sample_graph(spark)
    found = verify.verify_with_model(kg.nodes, kg.rels, lambda: ScriptedProvider(lambda p, s: {"issue_type": "odd", "severity": "low"} if "knows" in p else {}))
    assert [(r.issue_type, r.severity) for r in found.collect()] == [("odd", "low")]
    assert [(r.relation_type, r.target_entity) for r in reason.reason_over_path(kg, "ann", "maps").collect()] == [("qualified-for", "maps")]
    assert reason.reason_over_path(kg, "maps", "ann").count() == 0 and "Ann" in viz.to_html(kg)
