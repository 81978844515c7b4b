"""Coreference candidates and groups against all pairs."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from graphwright.operators import coref
from graphwright.schema import entity_frame


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _similarity(measure, a, b):
    if measure == "ratio":
        return SequenceMatcher(None, a, b).ratio()
    return 1.0 if a == b else 1 - _edits(a, b) / max(len(a), len(b))


@pytest.mark.parametrize("measure", ["ratio", "edit"])
@pytest.mark.parametrize("sweeps", [0, 2])
def test_pairs_and_groups_equal_all_pairs(spark, monkeypatch, measure, sweeps):
    monkeypatch.setattr(coref, "BLOCK", 7)
    monkeypatch.setattr(coref, "SWEEPS", sweeps)
    rng = random.Random(4)
    base = [f"Customer {i:03}" for i in range(8)] + ["alpha beta", "alpha betas", "alpah beta", "gamma", "gama", "", "\u00e9\u6f22", "\u00e9\u6f22\u5b57"]
    rows = [{"id": f"e{i:03}", "name": rng.choice(base).upper() if i % 3 else rng.choice(base), "type": rng.choice("PQ"), "ord": i} for i in range(90)]
    entities = entity_frame(spark, rows)
    similar = {}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            s = _similarity(measure, a["name"].strip().lower(), b["name"].strip().lower())
            if a["type"] == b["type"] and s >= coref.THRESHOLD:
                similar[a["id"], b["id"]] = round(s, 6)
    if not sweeps:
        assert {(r.id1, r.id2): round(r.similarity, 6) for r in coref.similar_pairs(entities, measure=measure).collect()} == similar
    taken = {}
    for i, a in enumerate(rows):
        if a["id"] not in taken:
            taken |= {b["id"]: a["id"] for b in rows[i + 1 :] if b["id"] not in taken and (a["id"], b["id"]) in similar}
    assert {r.id: r.center for r in coref.similar_groups(entities, measure=measure).collect()} == taken
    assert coref.similar_groups(entity_frame(spark, [])).count() == 0
