"""Results that bounds used to cut: long cycles, long chains, deep trees; and round trips of every column."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from graphwright.operators import conflicts, coref, extract, segment, traverse, verify
from graphwright.operators.graph import KG
from graphwright.operators.provider import RuleProvider, ScriptedProvider
from graphwright.schema import SEGMENTS, entity_frame, relationship_frame
from graphwright.sources import graph_io


def _rels(spark, rows):
    return relationship_frame(spark, [{"id": f"r{i}", "source": a, "target": b, "type": t, "confidence": c} for i, (a, b, t, c) in enumerate(rows)])


def _edges(spark, rows):
    return spark.createDataFrame(rows, "kind string, s string, t string")


def _components(rows):
    """Nodes on cycles by reachability, kind by kind."""
    out = {}
    for kind in {k for k, _, _ in rows}:
        step = {}
        for k, a, b in rows:
            if k == kind and a != b:
                step.setdefault(a, set()).add(b)
        reach = {}
        for a in step:
            seen, open_ = set(), [a]
            while open_:
                for b in step.get(open_.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        open_.append(b)
            reach[a] = seen
        for a in reach:
            if a in reach[a]:
                out[kind, a] = frozenset(b for b in reach[a] if a in reach.get(b, ()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components_equal_reachability(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("xy"), f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(75)] + [("z", f"c{i:02}", f"c{(i + 1) % 12:02}") for i in range(12)]
    truth = _components(rows)
    found = {}
    for r in traverse.strong_components(_edges(spark, rows)).collect():
        found.setdefault((r.kind, r.component), set()).add(r.node)
    assert {(k, n): frozenset(members) for (k, _), members in found.items() for n in members} == truth
    for r in traverse.cycle_witnesses(_edges(spark, rows)).collect():
        steps = list(zip(r.nodes, [*r.nodes[1:], r.nodes[0]], strict=True))
        assert all((r.kind, a, b) in rows for a, b in steps) and len(set(r.nodes)) == r.length and r.start == r.nodes[0] == min(truth[r.kind, r.start]) and r.members == len(truth[r.kind, r.start])


def test_no_cycle_is_too_long(spark):
    ring = [(f"a{i}", f"a{(i + 1) % 5}", "is-a", 0.9 - 0.1 * (i == 3)) for i in range(5)] + [("b0", "b1", "is-a", 0.9), ("b1", "b0", "is-a", 0.8), ("a0", "b0", "is-a", 0.9), ("d", "d", "is-a", 0.9)]
    rels = _rels(spark, ring)
    assert sorted((r.start, r.length) for r in verify.hierarchy_cycles(rels).collect()) == [("a0", 5), ("b0", 2)]
    kg = KG(entity_frame(spark, [{"id": x, "name": x, "type": "T"} for x in ("a0", "a1", "a2", "a3", "a4", "b0", "b1", "d")]), rels)
    assert sorted((r.start, tuple(r.nodes)) for r in conflicts.circular_hierarchies(kg).collect()) == [("a0", ("a0", "a1", "a2", "a3", "a4")), ("b0", ("b0", "b1"))]
    left = conflicts.resolve_cycles(kg)
    assert {r.id for r in left.rels.collect()} == {f"r{i}" for i in range(9)} - {"r3", "r6"}
    assert conflicts.circular_hierarchies(left).count() == 0 and traverse.strong_components(_edges(spark, [])).count() == 0


def test_cycles_of_parallel_relationships_are_resolved(spark):
    rels = _rels(spark, [("a", "b", "is-a", 0.9), ("a", "b", "is a", 0.6), ("b", "a", "is-a", 0.7)])
    kg = KG(entity_frame(spark, [{"id": x, "name": x, "type": "T"} for x in "ab"]), rels)
    assert conflicts.circular_hierarchies(conflicts.resolve_cycles(kg)).count() == 0


@pytest.mark.parametrize("length", [2, 8, 15])
def test_denials_of_long_chains(spark, length):
    rows = [(f"n{i}", f"n{i + 1}", "is-a", 1.0) for i in range(length)] + [("n0", f"n{length}", "is-not-a", 1.0), (f"n{length}", "n0", "is-a", 1.0), ("n0", "n0", "different-from", 1.0)]
    found = verify.transitive_contradictions(_rels(spark, rows)).collect()
    assert [(r.source_entity, r.target_entity, r.distance) for r in found] == [("n0", f"n{length}", length)]
    assert verify.transitive_contradictions(_rels(spark, rows), max_hops=length - 1).count() == 0


def test_deep_segment_trees(spark):
    columns = [c.split()[0] for c in SEGMENTS.split(", ")]
    rows = [{"doc_id": "d", "id": f"s{i}", "parent_id": f"s{i - 1}" if i else None} for i in range(20)] + [{"doc_id": "d", "id": "x", "parent_id": "y"}, {"doc_id": "d", "id": "y", "parent_id": "x"}]
    tree = segment.hierarchy(spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], SEGMENTS)).collect()
    assert {r.id: r.depth for r in tree} == {f"s{i}": i for i in range(20)} and segment.hierarchy(spark.createDataFrame([], SEGMENTS)).count() == 0


def test_control_characters_do_not_cut_segments(spark):
    text = "one\x01two words.\n\n \n\nthird\x01\x01 part. " + "Long sentence here. " * 12 + "\n\n\x01\n\nlast"
    rows = segment.rule_segments(spark.createDataFrame([("d", text), ("e", None), ("f", "\n\n"), ("g", "x"), ("g", "x")], "doc_id string, text string")).collect()
    assert all(text[r.start : r.end] == r.text for r in rows if r.doc_id == "d")
    assert [r.text for r in sorted(rows, key=lambda r: r.ord) if r.doc_id == "d" and r.level == 1] == ["one\x01two words.", ("third\x01\x01 part. " + "Long sentence here. " * 12).strip(), "\x01", "last"]
    assert sum(r.level == 2 for r in rows) == 13 and sum(r.level == 0 for r in rows) == 5


def _plain(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect())


def test_round_trips_keep_every_column(spark, tmp_path):
    odd = ' <a> & "b"\n\t\'c\' | null é\r '
    nodes = [{"id": 'i"<1>', "name": odd, "type": "T", "context": odd, "attributes": {"k": odd, "n": 1, "l": [1, {"x": None}], "null": "null"}, "metadata": {}, "confidence": 0.25, "ord": 7}, {"id": "2", "name": "null", "type": "", "context": None}]
    kg = KG(entity_frame(spark, nodes), relationship_frame(spark, [{"id": "r", "source": 'i"<1>', "target": "2", "type": "t & u", "context": odd, "bidirectional": True, "strength": 0.5, "confidence": 0.125, "attributes": {"a": True}}, {"id": "q", "source": "2", "target": "2"}]), name="g", meta={"k": "v"})
    for form in ("json", "graphml"):
        graph_io.export(kg, str(tmp_path / form), form)
        again = graph_io.import_graph(spark, str(tmp_path / form), form)
        for a, b in ((kg.nodes, again.nodes), (kg.rels, again.rels)):
            assert _plain(a) == _plain(b), form
        assert again.edges.count() == kg.edges.count() == 3
    assert graph_io.import_graph(spark, str(tmp_path / "json"), "json").name == "g"
    (tmp_path / "one.json").write_text(graph_io.to_json(kg))
    nested = graph_io.read_json(spark, str(tmp_path / "one.json"))
    for a, b in ((kg.nodes, nested.nodes), (kg.rels, nested.rels)):
        assert _plain(a) == _plain(b)
    (tmp_path / "two.json").write_text(json.dumps({"entities": [{"name": "N", "type": "T"}]}))
    assert graph_io.read_json(spark, str(tmp_path / "two.json")).nodes.count() == 1


def test_the_offline_provider_answers_every_task(spark):
    docs = spark.createDataFrame([("d", "First part. More.\n\nSecond part is " + "a long one. " * 30), ("e", None)], "doc_id string, text string")
    rows = segment.segment_text(docs, RuleProvider).collect()
    assert sum(r.level == 0 for r in rows) == 2 and sum(r.level == 1 for r in rows) == 30 and {r.doc_id for r in rows} == {"d"}
    kg = KG(entity_frame(spark, [{"id": x, "name": x, "type": "T"} for x in "ab"]), _rels(spark, [("a", "b", "is-a", 1.0), ("a", "b", "is-not-a", 1.0), ("b", "b", "is-a", 1.0)]))
    issues = verify.verify_with_model(kg.nodes, kg.rels, RuleProvider).collect()
    assert sorted((r.issue_type, sorted(r.involved_elements)) for r in issues) == [("contradictory_relationships", ["r0", "r1"]), ("self_reference", ["r2"])]


def test_a_provider_decides_coreference(spark):
    names = ["Ann Lee", "Ann Lee Jr", "Bob Ray", "Bob Roy"]
    kg = KG(entity_frame(spark, [{"id": f"e{i}", "name": n, "type": "P"} for i, n in enumerate(names)]), _rels(spark, [("e1", "e2", "knows", 1.0)]))
    out, groups, mapping = coref.resolve(kg, provider=RuleProvider)
    assert {tuple(r.entity_ids): (r.canonical_name, r.merge_decision) for r in groups.collect()} == {("e0", "e1"): ("Ann Lee Jr", True), ("e2", "e3"): ("Bob Ray", False)}
    assert {r.old_id: r.new_id for r in mapping.collect()} == {"e0": "e0", "e1": "e0", "e2": "e2", "e3": "e3"} and out.rels.first().source_entity == "e0"

    def fails(prompt, schema):
        raise ValueError("no answer")

    kept = coref.resolve(kg, provider=lambda: ScriptedProvider(fails))[1].collect()
    assert all(r.merge_decision for r in kept) and len(kept) == 2


def test_merging_takes_one_entity(spark):
    kg = KG(entity_frame(spark, [{"id": x, "name": x, "type": "T"} for x in "abc"]), _rels(spark, [("a", "c", "t", 1.0)]))
    with pytest.raises(ValueError, match="exactly one"):
        kg.merge_entities(["a", "b"], entity_frame(spark, [{"id": "m", "name": "m", "type": "T"}, {"id": "n", "name": "n", "type": "T"}]))
    assert kg.merge_entities(["a", "b"], entity_frame(spark, [{"id": "m", "name": "m", "type": "T"}])).rels.first().source_entity == "m"


@pytest.mark.parametrize("few", [0, 100])
def test_contexts_in_long_texts(spark, monkeypatch, few):
    monkeypatch.setattr(extract, "FEW_QUOTES", few)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé 漢😀") for _ in range(3000)) for _ in range(6)] + ["short", "", None]
    quotes = [t[k : k + n] for t in texts[:6] for k, n in ((0, 24), (2976, 24), (100, 500), (7, 40))] + ["b" * 40, "short"]
    segments = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    entities = entity_frame(spark, [{"id": f"q{i}", "name": "n", "type": "T", "context": q} for i, q in enumerate(quotes)])
    found = {(r.segment_id, r.entity_id) for r in extract.entities_in_segments(segments, entities, strict=True).collect()}
    assert found == {(str(i), f"q{k}") for i, t in enumerate(texts) for k, q in enumerate(quotes) if t and q in t}


def test_blanks_do_not_use_the_language_sample_up(spark):
    from graphwright.functions import language, text

    rows = [(1, " \n" * 20_000 + "the house and the garden of the king is old"), (2, " \n "), (3, None)]
    out = {r.id: r.x for r in spark.createDataFrame(rows, "id int, t string").select("id", language.detect_language(F.col("t")).alias("x")).collect()}
    assert out == {1: "en", 2: None, 3: None}
    cases = ["x" * 600, "a. " * 300, "word " * 200, "", None, "y" * 499 + ". z" + "w" * 300, "short"]
    found = spark.createDataFrame(list(enumerate(cases)), "id int, t string").select("id", text.best_split_point(F.col("t"), 500).alias("x")).collect()

    def plain(value):
        import re

        if value is None or len(value) <= 500:
            return None if value is None else len(value)
        for pattern in (r"[.!?]\s+", r"\s+"):
            ends = [m.end() + 400 for m in re.finditer(pattern, value[400:600])]
            if ends:
                return min(ends, key=lambda e: abs(e - 500))
        return 500

    assert {r.id: r.x for r in found} == {i: plain(t) for i, t in enumerate(cases)}
