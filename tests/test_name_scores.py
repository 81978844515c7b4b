"""Scores of many names at once against difflib and the plain edit distance, and pairs of units of entities."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from test_coref import _edits, _similarity

from graphwright.operators import coref, name_scores
from graphwright.plans import registry, testgraph
from graphwright.schema import entity_frame


@pytest.mark.parametrize("alphabet", ["ab", "0123456789", "\u00e9\u6f22x\U0001f600"])
@pytest.mark.parametrize("start", ["", "aaaa", "abababab", "aabbaabbaabb", "customer#0000", "x" * 195])
def test_scores_are_those_of_the_plain_forms(alphabet, start):
    some = random.Random(5)
    for longest in (2, 6, 45):
        left, right = ([start + "".join(some.choices(alphabet, k=some.randrange(longest))) for _ in range(12)] for _ in range(2))
        i, j = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(12), indexing="ij"))
        wanted = [sum(m.size for m in SequenceMatcher(None, left[x], right[y]).get_matching_blocks()) for x, y in zip(i, j, strict=True)]
        assert name_scores.matches(left, right, i, j).tolist() == wanted
        assert name_scores.edits(left, right, i, j).tolist() == [_edits(left[x], right[y]) for x, y in zip(i, j, strict=True)]


@pytest.mark.parametrize("measure", ["ratio", "edit"])
def test_pairs_of_names_in_units_and_blocks(spark, monkeypatch, measure):
    monkeypatch.setattr(coref, "UNIT", 3)
    monkeypatch.setattr(coref, "BLOCK", 5)
    some = random.Random(6)
    names = ["anna lee", "ana lee", "lee anna", "tide", "diet", "", "customer#01", "customer#10"]
    # Numbers of entities are no order of names, and some are equal.
    rows = [{"id": f"e{i:03}", "name": some.choice(names), "type": some.choice("PQ"), "ord": some.randrange(60)} for i in range(120)]
    rows.sort(key=lambda r: (r["ord"], r["id"]))
    wanted = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            s = _similarity(measure, a["name"], b["name"])
            if a["type"] == b["type"] and s >= 0.5:
                wanted[a["id"], b["id"]] = round(s, 3)
    got = coref.similar_pairs(entity_frame(spark, rows), 0.5, measure, digits=3).collect()
    assert len(got) == len(wanted) and {(r.id1, r.id2): r.similarity for r in got} == wanted
    assert all((r.ord1, r.id1) < (r.ord2, r.id2) for r in got)


@pytest.mark.parametrize("name", ["coref_edit", "coref_ratio"])
def test_queries_of_entities_build_no_relationships(spark, monkeypatch, name):
    monkeypatch.setattr(testgraph, "_LOADED", {})
    monkeypatch.setattr(testgraph, "_build_relationships", lambda *_: pytest.fail("built"))
    registry.queries()[name](spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("measure", ["ratio", "edit"])
def test_rows_of_scores_are_small_and_listed_without_a_join(spark, monkeypatch, measure):
    monkeypatch.setattr(coref, "RIGHTS", 7)
    monkeypatch.setattr(coref, "BLOCK", 16)
    # Alike names meet in company, words only where they are similar.
    names = [f"Customer#{i:05}" for i in range(40)] + ["tide", "diet", "tied", "lee"] * 5
    rows = [{"id": f"e{i:03}", "name": n, "type": "P", "ord": i * 37 % 61} for i, n in enumerate(names)]
    entities = entity_frame(spark, rows)
    sizes = [(len(r.ids2), len(r.lefts), {len(x.k) for x in r.lefts}) for r in coref._block_scores(coref._unit_blocks(entities), 0.7, measure, 6).collect()]
    assert max(s[0] for s in sizes) == 7 and max(s[1] for s in sizes) == coref.LEFTS and all(s[2] == {s[0]} for s in sizes)
    rows.sort(key=lambda r: (r["ord"], r["id"]))
    low = [r["name"].lower() for r in rows]
    wanted = {(a["id"], b["id"]) for i, a in enumerate(rows) for j, b in enumerate(rows[i + 1 :], i + 1) if _similarity(measure, low[i], low[j]) >= 0.7}
    found = coref.similar_pairs(entities, 0.7, measure)
    got = found.collect()
    assert len(got) == len(wanted) and {(r.id1, r.id2) for r in got} == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    # All that follows the scores is the listing of their pairs.
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")] and "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]


@pytest.mark.parametrize("longest", [3, 8, 9, 33, 64, 65, 90])
@pytest.mark.parametrize("alphabet", ["ab", "0123456789", "é漢x\U0001f600"])
def test_edits_of_short_texts_are_counted_in_bits(monkeypatch, alphabet, longest):
    some, taken = random.Random(7), []
    rows = name_scores._edits_in_rows
    monkeypatch.setattr(name_scores, "_edits_in_rows", lambda *x: taken.append(len(x[4])) or rows(*x))
    left, right = ([start + "".join(some.choices(alphabet, k=some.choice([longest, some.randrange(longest + 1)]))) for start in "xyz" * 3] for _ in range(2))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(9), np.arange(9), indexing="ij"))
    assert name_scores.edits(left, right, i, j).tolist() == [_edits(left[x], right[y]) for x, y in zip(i, j, strict=True)]
    assert sum(taken) == sum(len(left[x]) > 64 for x in i)
    monkeypatch.setattr(name_scores, "TABLE", 0)
    assert name_scores.edits(left, right, i, j).tolist() == [_edits(left[x], right[y]) for x, y in zip(i, j, strict=True)]


@pytest.mark.parametrize("alphabet", ["ab", "0123456789", "é漢x\U0001f600"])
@pytest.mark.parametrize("start", ["", "aaaa", "customer#0000"])
def test_matches_of_short_texts_are_scored_once_for_equal_places(monkeypatch, alphabet, start):
    some, scored = random.Random(8), []
    plain = name_scores._longest_first
    monkeypatch.setattr(name_scores, "BATCH", 100)
    monkeypatch.setattr(name_scores, "_KNOWN", {})
    monkeypatch.setattr(name_scores, "_longest_first", lambda a, *x: scored.append(a.shape[1]) or plain(a, *x))
    left, right = ([start + "".join(some.choices(alphabet, k=some.choice([5, some.randrange(6)]))) for _ in range(40)] for _ in range(2))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40), indexing="ij"))
    wanted = [sum(m.size for m in SequenceMatcher(None, left[x], right[y]).get_matching_blocks()) for x, y in zip(i, j, strict=True)]
    for _ in range(2):
        assert name_scores.matches(left, right, i, j).tolist() == wanted
    # Texts of nine and more characters have too many places.
    if start != "aaaa":
        assert sum(scored) < 1600
