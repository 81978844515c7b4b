"""Converged trust and distrust against a linear solve, with a host that eight rounds judge wrongly."""

from __future__ import annotations

import numpy as np

from graphwright.llm import urlfilter


def test_converged_scores_and_verdicts(spark):
    # a.b.co.uk and b.co.uk are linked both ways by their names; c.site links to a host with half its pages blocked.
    names = ["a.b.co.uk", "b.co.uk", "x.net", "c.site"]
    rows = [(0, "http://a.b.co.uk/1", '<a href="http://x.net/">'), (1, "http://b.co.uk/1", ""), (2, "http://x.net/1", '<a href="http://c.site/">'), (3, "http://c.site/1", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(0, 2): 1, (0, 1): 1, (1, 0): 1, (2, 3): 1}
    m = np.zeros((4, 4))
    for (src, dst), w in edges.items():  # distrust flows from dst to src
        m[src, dst] = 0.85 * w / sum(v for (_, d), v in edges.items() if d == dst)
    exact = np.linalg.solve(np.eye(4) - m, 0.15 * np.array([0, 0, 1, 0]))
    short = sum(np.linalg.matrix_power(m, k) for k in range(9)) @ (0.15 * np.array([0, 0, 1, 0]))
    assert exact[1] >= 0.075 and abs(exact - short).max() > 1e-3
    found = {r.host: r for r in urlfilter.judge(pages, parents=True).collect()}
    assert all(abs(found[h].distrust - e) < 2e-6 for h, e in zip(names, exact, strict=True))
    assert [found[h].verdict for h in names] == ["block" if e >= 0.075 else "allow" for e in exact]
