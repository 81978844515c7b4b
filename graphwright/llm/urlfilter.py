"""URL filters: path rules, then trust and distrust propagated over the host graph.

Rules (host, path, verdict) fit a host and its subdomains where the url's path
starts with the rule's; the longest fitting rule decides.  Urls without a rule
take their host's verdict by link-graph propagation: hosts are seeded with the
share of their pages that rules allow (trust) and block (distrust); trust flows
along links (personalised PageRank from trusted seeds), distrust against them
(hosts that link to blocked ones inherit it).  A host is blocked if its distrust
exceeds its trust and reaches ``THRESHOLD`` of what a wholly blocked host without
links has.  Scores are not normalised to a sum, so they do not depend on how many
hosts there are.

Host edges: links of the pages to other hosts, weighted by their number.  A link is an
``href`` in any letter case, quoted or not, with an ``http`` or ``https`` url or one that
begins with ``//``; relative links stay on their host and make no edge.  With ``parents``
there are also edges both ways between a host and the host named without its first
label, while three labels remain; that is a statement about names, not about links.

Both scores are those of the converged propagation: rounds go on until all later ones
together would add less than ``LEFT`` to any score.  A host graph of up to ``SMALL`` rows is
finished in one task, a larger one by joins, ``CHAIN`` rounds a job.  Hubs have their links dealt over
several places, to which their one score is sent.

Defined results: null urls and urls without ``://`` have empty host and path, no
rule, and the method's verdict of the empty host; null html has no links; ties go
to allow; repeated rows count as pages; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.plans.durable import durable
from graphwright.plans.skew import attach

#: (host, path, verdict); fixed values of the production rule list.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING = 0.85
#: What later rounds may add to any score; scores are rounded at 1e-6.
LEFT = 1e-8
#: Rounds of one job; links of a hub that are dealt to one place.
CHAIN, PER_PLACE = 8, 4096
#: Rows of a host graph up to which one task runs all rounds; a constant, whatever the input. Larger ones go round by round.
SMALL = 50_000
THRESHOLD = 0.5
HREF = r"""(?i)(?:^|[\s"'/])href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'<>\s]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _by_rules(host: Column, path: Column, rules, value) -> Column:
    out = None
    for rule in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        out = F.when(fits, value(rule)) if out is None else out.when(fits, value(rule))
    return out if out is not None else F.lit(None).cast("string")


def judged_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, rule_verdict)``."""
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    return parts.select(
        "page_id", "host", "path",
        _by_rules(host, path, rules, lambda r: r[0] + r[1]).alias("rule"),
        _by_rules(host, path, rules, lambda r: r[2]).alias("rule_verdict"),
    )


def host_edges(pages: DataFrame, parents: bool = False) -> DataFrame:
    """``(src, dst, w)``: links between different hosts with their number, as counted over all pages; see the module's docstring."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    if parents:
        up = pages.select(host_of(F.col("url")).alias("src")).distinct().select("src", F.regexp_extract("src", r"^[^.]+\.([^.]+\.[^.]+\..+)$", 1).alias("dst"))
        up = up.where("dst <> ''").select("src", "dst", F.lit(1).cast("long").alias("w"))
        links = links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return links.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _ways(seeds: DataFrame, edges: DataFrame, damping: float) -> DataFrame:
    """``(node, place, to, to_places, p, stays)``: where a node's score goes, cut by ``place``, and one row a node that keeps its total.

    A node is a host in one of the two propagations.
    """
    forth = edges.select(F.concat(F.lit("t:"), "src").alias("node"), F.concat(F.lit("t:"), "dst").alias("to"), "w")
    back = edges.select(F.concat(F.lit("d:"), "dst").alias("node"), F.concat(F.lit("d:"), "src").alias("to"), "w")
    ways = durable(forth.unionByName(back), "ways")
    out = ways.groupBy("node").agg(F.sum("w").alias("out"), F.count(F.lit(1)).alias("n"))
    out = durable(out.withColumn("places", F.ceil(F.col("n") / PER_PLACE).cast("int")), "out")
    seeded = seeds.select(F.explode(F.array(F.concat(F.lit("t:"), "host"), F.concat(F.lit("d:"), "host"))).alias("node"))
    every = seeded.unionByName(ways.select("node")).unionByName(ways.select(F.col("to").alias("node"))).distinct()
    nodes = durable(every.join(out.select("node", "places"), "node", "left").select("node", F.coalesce("places", F.lit(1)).alias("places")), "nodes")
    ways = attach(ways, out, "node", "n").withColumn("place", F.pmod(F.xxhash64("to", F.lit(9)), F.col("places")).cast("int"))
    fans = ways.groupBy("to").agg(F.count(F.lit(1)).alias("n")).join(nodes.withColumnRenamed("node", "to"), "to").withColumnRenamed("places", "to_places")
    ways = attach(durable(ways.drop("places"), "placed"), durable(fans, "fans"), "to", "n")
    ways = ways.select("node", "place", "to", "to_places", (F.lit(damping) * F.col("w") / F.col("out")).alias("p"), F.lit(0.0).alias("stays"))
    keeps = nodes.select("node", F.lit(0).alias("place"), F.col("node").alias("to"), F.col("places").alias("to_places"), F.lit(0.0).alias("p"), F.lit(1.0).alias("stays"))
    return durable(ways.unionByName(keeps), "all-ways")


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """``(host, trust, distrust)`` of the converged propagation.

    ``seeds``: (host, trust, distrust) in [0, 1]; hosts of ``edges`` without a seed
    have 0.  Each round adds what the last one passed on: trust over each host's
    out-links in proportion to ``w``, distrust over its in-links.  A row of the state is
    (node, what it passes on next, its total so far).
    """
    ways = _ways(seeds, edges, damping)
    first = seeds.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{k[0]}:"), "host").alias("node"), F.col(k).alias("s")) for k in ("trust", "distrust")])).alias("x"))
    first = first.select("x.node", (F.lit(1 - damping) * F.col("x.s")).alias("s")).where("s > 0")
    if ways.count() <= SMALL:
        scores = _in_one_task(first, ways, damping)
        return _by_host(scores)
    places = ways.where("stays > 0").select("node", F.col("to_places").alias("places"))
    state = durable(first.join(places, "node").select("node", "places", "s", F.lit(0.0).alias("total")), "state")
    while (state.agg(F.sum("s")).first()[0] or 0.0) / (1 - damping) >= LEFT:
        ahead = state
        for _ in range(CHAIN):
            sent = ahead.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).join(ways, ["node", "place"])
            ahead = sent.groupBy(F.col("to").alias("node")).agg(
                F.first("to_places").alias("places"), F.sum(F.col("s") * F.col("p")).alias("s"), F.sum((F.col("total") + F.col("s")) * F.col("stays")).alias("total")
            )
        state = durable(ahead, "state", replaces=state)
    return _by_host(state.select("node", (F.col("total") + F.col("s")).alias("score")))


def _by_host(scores: DataFrame) -> DataFrame:
    """``(host, trust, distrust)`` of ``(node, score)``."""
    score = lambda kind: F.sum(F.when(F.col("node").startswith(f"{kind[0]}:"), F.col("score")).otherwise(0.0)).alias(kind)
    return scores.groupBy(F.substr("node", F.lit(3)).alias("host")).agg(score("trust"), score("distrust"))


def _in_one_task(first: DataFrame, ways: DataFrame, damping: float) -> DataFrame:
    """``(node, score)`` as the rounds of :func:`propagate` give them, for at most ``SMALL`` ways, in one task."""
    links = ways.where("stays = 0").select("node", "to", "p")
    rows = links.unionByName(first.select("node", F.lit(None).cast("string").alias("to"), F.col("s").alias("p")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        at, to, p, seeds = [], [], [], []
        for batch in batches:
            for node, target, value in zip(*(batch.column(c).to_pylist() for c in ("node", "to", "p")), strict=True):
                i = numbers.setdefault(node, len(numbers))
                if target is None:
                    seeds.append((i, value))
                else:
                    at.append(i)
                    to.append(numbers.setdefault(target, len(numbers)))
                    p.append(value)
        flow = np.zeros(len(numbers))
        for i, value in seeds:
            flow[i] += value
        total = flow.copy()
        source, target, share = np.array(at, np.int64), np.array(to, np.int64), np.array(p)
        while flow.sum() / (1 - damping) >= LEFT:
            flow = np.bincount(target, flow[source] * share, len(numbers))
            total += flow
        yield pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.string()), pa.array(total)], names=["node", "score"])

    return rows.coalesce(1).mapInArrow(run, "node string, score double")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, threshold: float = THRESHOLD, parents: bool = False) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for every row of ``pages``."""
    ruled = durable(judged_by_rules(pages, rules), "ruled")
    share = lambda verdict: (F.count_if(F.col("rule_verdict") == verdict) / F.count(F.lit(1))).alias
    seeds = durable(ruled.groupBy("host").agg(share("allow")("trust"), share("block")("distrust"), F.count(F.lit(1)).alias("n")), "seeds")
    scores = propagate(seeds, durable(host_edges(pages, parents), "edges"), damping)
    # Rounded before the comparison, so that the order of a sum cannot tip a verdict.
    scores = scores.select("host", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
    scores = durable(seeds.select("host", "n").join(scores, "host", "left"), "hosts")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    blocked = (distrust > trust) & (distrust >= F.round(F.lit(threshold * (1 - damping)), 6))
    return attach(ruled, scores, "host", "n").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )


def oracle_sql(table: str = "pages", rules=RULES, damping: float = DAMPING, threshold: float = THRESHOLD, parents: bool = False) -> str:
    """DuckDB SQL of :func:`judge`, by so many rounds that nothing is left to pass on."""
    rounds = 250
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for h, p, _ in ordered]
    rule = "CASE " + " ".join(f"{f} '{h}{p}'" for f, (h, p, _) in zip(fits, ordered, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"{f} '{v}'" for f, (_, _, v) in zip(fits, ordered, strict=True)) + " END"
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    href = HREF.replace("'", "''")
    named = " UNION ALL SELECT src, dst, 1 FROM up WHERE dst <> '' UNION ALL SELECT dst, src, 1 FROM up WHERE dst <> ''" if parents else ""
    return f"""
WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {table}),
parts AS (SELECT page_id, html, {lower("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, {rule} AS rule, {verdict} AS v FROM parts),
links AS (SELECT host AS src, {lower("unnest(regexp_extract_all(html, '" + href + "', 1))")} AS dst FROM parts),
up AS (SELECT DISTINCT host AS src, regexp_extract(host, '^[^.]+\\.([^.]+\\.[^.]+\\..+)$', 1) AS dst FROM parts),
pairs AS (SELECT src, dst, count(*) AS w FROM links WHERE src <> '' GROUP BY 1, 2{named}),
edges AS (SELECT src, dst, sum(w) AS w FROM pairs WHERE src <> dst GROUP BY 1, 2),
bothways AS (SELECT 'trust' AS kind, src AS a, dst AS b, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
ways AS (SELECT kind, a, b, {damping} * w / sum(w) OVER (PARTITION BY kind, a) AS p FROM bothways),
seeds AS (SELECT host, count(*) FILTER (v = 'allow') / count(*) AS trust, count(*) FILTER (v = 'block') / count(*) AS distrust FROM ruled GROUP BY 1),
flow AS (SELECT 0 AS turn, 'trust' AS kind, host AS a, {1 - damping} * trust AS s FROM seeds WHERE trust > 0
  UNION ALL SELECT 0, 'distrust', host, {1 - damping} * distrust FROM seeds WHERE distrust > 0
  UNION ALL SELECT turn + 1, kind, b, sum(s * p) FROM flow JOIN ways USING (kind, a) WHERE turn < {rounds} GROUP BY turn, kind, b),
scores AS (SELECT a AS host, round(sum(CASE WHEN kind = 'trust' THEN s ELSE 0 END), 6) AS trust, round(sum(CASE WHEN kind = 'distrust' THEN s ELSE 0 END), 6) AS distrust FROM flow GROUP BY 1)
SELECT page_id, ruled.host, path, rule,
  coalesce(v, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) AND coalesce(distrust, 0) >= round({threshold * (1 - damping)}, 6) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0.0)::DOUBLE AS trust, coalesce(distrust, 0.0)::DOUBLE AS distrust
FROM ruled LEFT JOIN scores ON ruled.host = scores.host"""
