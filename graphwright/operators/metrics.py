"""Graph statistics, components and centralities over ``KG.edges``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.operators.components import contract_components
from graphwright.operators.graph import KG
from graphwright.plans.durable import durable


def type_counts(kg: KG) -> DataFrame:
    return kg.nodes.groupBy("entity_type").agg(F.count(F.lit(1)).alias("entities"))


def relation_type_counts(kg: KG) -> DataFrame:
    return kg.rels.groupBy("relation_type").agg(F.count(F.lit(1)).alias("relationships"))


def degrees(kg: KG) -> DataFrame:
    """``(id, in_degree, out_degree)`` of every entity."""
    ends = kg.edges.select(F.col("t").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(kg.edges.select(F.col("s").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    counts = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = F.lit(0).cast("bigint")
    return kg.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("in_degree", zero).alias("in_degree"), F.coalesce("out_degree", zero).alias("out_degree"))


def degree_centrality(kg: KG) -> DataFrame:
    """``(id, score)``: degree over n - 1; 1 for a lone entity."""
    n = kg.nodes.agg(F.count(F.lit(1)).alias("__n"))
    rows = degrees(kg).crossJoin(F.broadcast(n))
    return rows.select("id", F.when(F.col("__n") <= 1, 1.0).otherwise((F.col("in_degree") + F.col("out_degree")) / (F.col("__n") - 1)).alias("score"))


#: Edges that one task may finish when components of a whole graph are wanted; a constant, whatever the input.
FEW = 1 << 18


def components(kg: KG, arcs: DataFrame | None = None) -> DataFrame:
    """``(id, component)``: weak components named by their least id; lone entities are their own."""
    roots = durable(contract_components(kg.arcs if arcs is None else arcs, "s", "t", FEW), "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    named = roots.join(least, "root").select(F.col("node").alias("id"), "component")
    return kg.nodes.select("id").join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def clustering(kg: KG, arcs: DataFrame | None = None) -> DataFrame:
    """``(id, score)``: directed clustering coefficient of every entity.

    Edges become undirected pairs weighing 1 or 2 (both directions); triangles are
    listed once by orienting pairs from lower to higher degree, which bounds the
    wedges at hubs.
    """
    pair = (kg.arcs if arcs is None else arcs).where("s <> t").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    pair = durable(pair, "pairs")
    ends = pair.select(F.col("a").alias("id"), "w").unionByName(pair.select(F.col("b").alias("id"), "w"))
    total = durable(ends.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("d"), F.sum(F.when(F.col("w") == 2, 1).otherwise(0)).alias("both")), "degrees")
    rank = total.select("id", F.struct("k", "id").alias("r"))
    ranked = pair.join(rank.withColumnsRenamed({"id": "a", "r": "ra"}), "a").join(rank.withColumnsRenamed({"id": "b", "r": "rb"}), "b")
    up = F.col("ra") < F.col("rb")
    arcs = durable(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"), F.when(up, F.col("rb")).otherwise(F.col("ra")).alias("rv"), "w"), "arcs")
    wedge = arcs.select("u", F.col("v").alias("v1"), F.col("rv").alias("r1"), F.col("w").alias("w1")).join(arcs.select("u", F.col("v").alias("v2"), F.col("rv").alias("r2"), F.col("w").alias("w2")), "u").where("r1 < r2")
    close = arcs.select(F.col("u").alias("v1"), F.col("v").alias("v2"), F.col("w").alias("w3"))
    found = wedge.join(close, ["v1", "v2"]).select(F.explode(F.array("u", "v1", "v2")).alias("id"), (F.col("w1") * F.col("w2") * F.col("w3")).alias("p"))
    triangles = found.groupBy("id").agg(F.sum("p").alias("t"))
    whole = kg.nodes.select("id").join(total, "id", "left").join(triangles, "id", "left")
    possible = F.col("d") * (F.col("d") - 1) - 2 * F.col("both")
    return whole.select("id", F.when(F.col("t").isNull(), 0.0).otherwise(F.col("t") / possible).alias("score"))


def distances(kg: KG, sources: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """``(source, id, hops)``: directed distances from the given sources (all entities), 0 included.

    One row per reachable pair: give sources or a hop bound on large graphs.
    """
    start = (sources if sources is not None else kg.nodes).select(F.col("id").alias("source"))
    step = durable(kg.arcs.where("s <> t").select(F.col("s").alias("id"), F.col("t").alias("to")), "steps")
    found = start.select("source", F.col("source").alias("id"), F.lit(0).alias("hops"))
    level, seen, hops = None, None, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        if level is None:
            # The first step leads to another entity always: nothing has to be joined but the sources.
            onward = step.select(F.col("id").alias("source"), F.col("to").alias("id")).join(start, "source", "left_semi")
        else:
            onward = level.join(step, "id").select("source", F.col("to").alias("id")).where("source <> id").distinct().join(seen, ["source", "id"], "left_anti")
        level = durable(onward.withColumn("hops", F.lit(hops)), "level")
        if level.isEmpty():
            break
        seen = level if seen is None else seen.unionByName(level)
    return found if seen is None else found.unionByName(seen)


def closeness(kg: KG, reach: DataFrame | None = None) -> DataFrame:
    """``(id, score)``: inverse mean distance to the entity over those that reach it, scaled by their share."""
    reach = distances(kg) if reach is None else reach
    n = F.broadcast(kg.nodes.agg(F.count(F.lit(1)).alias("__n")))
    sums = reach.groupBy("id").agg(F.count(F.lit(1)).alias("r"), F.sum("hops").alias("total")).crossJoin(n)
    score = F.when((F.col("total") > 0) & (F.col("__n") > 1), (F.col("r") - 1) / F.col("total") * ((F.col("r") - 1) / (F.col("__n") - 1))).otherwise(0.0)
    return sums.select("id", score.alias("score"))


def average_path_length(kg: KG, reach: DataFrame | None = None) -> DataFrame:
    """One row ``(average)``: null unless the graph is strongly connected."""
    reach = distances(kg) if reach is None else reach
    n = kg.nodes.agg(F.count(F.lit(1)).alias("n"))
    pairs = reach.where("hops > 0").agg(F.count(F.lit(1)).alias("p"), F.sum("hops").alias("total"))
    full = F.col("p") == F.col("n") * (F.col("n") - 1)
    return pairs.crossJoin(n).select(F.when(full & (F.col("n") > 1), F.col("total") / F.col("p")).alias("average"))


def betweenness(kg: KG, sources: DataFrame | None = None) -> DataFrame:
    """``(id, score)``: shortest-path betweenness, normalised by (n - 1)(n - 2).

    All given sources (default: all entities) advance together: levels forwards count
    shortest paths, levels backwards share out dependencies.  With a sample of
    sources scores are scaled up by n over their number.
    """
    start = (sources if sources is not None else kg.nodes).select(F.col("id").alias("source"))
    step = durable(kg.arcs.where("s <> t").select(F.col("s").alias("id"), F.col("t").alias("to")), "steps")
    # A source's own entity passes nothing on, so the levels begin with the first step.
    times = start.groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("sigma"))
    level = durable(step.select(F.col("id").alias("source"), F.col("to").alias("id")).join(times, "source").select("source", "id", "sigma"), "level")
    levels, seen = [level], level.select("source", "id")
    while not level.isEmpty():
        onward = level.join(step, "id").where("source <> to").groupBy("source", F.col("to").alias("__to")).agg(F.sum("sigma").alias("sigma")).withColumnRenamed("__to", "id")
        level = durable(onward.join(seen, ["source", "id"], "left_anti").select("source", "id", "sigma"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("source", "id"))
    below = levels[-1].select("source", "id", "sigma", F.lit(0.0).alias("delta"))
    parts = []
    for depth in range(len(levels) - 2, -1, -1):
        here = levels[depth]
        share = here.join(step, "id").join(
            below.select("source", F.col("id").alias("to"), F.col("sigma").alias("s2"), F.col("delta").alias("d2")), ["source", "to"]
        ).groupBy("source", "id").agg(F.sum(F.col("sigma") / F.col("s2") * (1 + F.col("d2"))).alias("delta"))
        below = durable(here.join(share, ["source", "id"], "left").select("source", "id", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")), "below")
        parts.append(below.select("id", "delta"))
    n, k = kg.nodes.count(), start.count()
    scale = n / k / ((n - 1) * (n - 2)) if n > 2 and k else 0.0
    base = kg.nodes.select("id", F.lit(0.0).alias("delta"))
    for part in parts:
        base = base.unionByName(part)
    return base.groupBy("id").agg((F.sum("delta") * scale).alias("score"))


def _iterate(step: Callable[[DataFrame], DataFrame], start: DataFrame, rounds: int, tolerance: float | None, n: int) -> tuple[DataFrame, bool]:
    """Repeat ``step`` until the summed change is below n * tolerance, or for all rounds where that is null."""
    current = start
    for _ in range(rounds):
        new = durable(step(current), "rank")
        if tolerance is not None:
            change = new.join(current.withColumnRenamed("score", "old"), "id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
            if (change or 0.0) < n * tolerance:
                return new, True
        current = new
    return current, tolerance is None


def pagerank(kg: KG, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """``(id, score)``: unweighted PageRank with uniform dangling mass; ``tolerance=None`` runs exactly ``rounds``."""
    n = kg.nodes.count()
    if not n:
        return kg.nodes.select("id", F.lit(0.0).alias("score"))
    out = kg.edges.groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    links = durable(kg.edges.select("s", "t").join(out, "s").select(F.col("s").alias("id"), "t", (F.lit(damping) / F.col("k")).alias("p")), "links")
    nodes = durable(kg.nodes.select("id").join(out.select(F.col("s").alias("id"), F.lit(False).alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(True)).alias("dangling")), "nodes")

    def step(ranks: DataFrame) -> DataFrame:
        lost = ranks.join(nodes.where("dangling"), "id", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        got = ranks.join(links, "id").groupBy("t").agg(F.sum(F.col("score") * F.col("p")).alias("got"))
        rows = nodes.join(got, nodes["id"] == got["t"], "left").crossJoin(F.broadcast(lost))
        return rows.select("id", (F.coalesce("got", F.lit(0.0)) + F.lit(damping / n) * F.col("lost") + F.lit((1 - damping) / n)).alias("score"))

    ranks, done = _iterate(step, nodes.select("id", F.lit(1.0 / n).alias("score")), rounds, tolerance, n)
    if not done:
        raise ArithmeticError(f"PageRank did not converge in {rounds} rounds")
    return ranks


def eigenvector(kg: KG, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """``(id, score)``: eigenvector centrality by power iteration over in-links (with a unit shift)."""
    n = kg.nodes.count()
    links = durable(kg.edges.select(F.col("s").alias("id"), "t"), "links")

    def step(ranks: DataFrame) -> DataFrame:
        got = ranks.join(links, "id").groupBy("t").agg(F.sum("score").alias("got"))
        new = ranks.join(got, ranks["id"] == got["t"], "left").select("id", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("score"))
        norm = new.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))
        return new.crossJoin(F.broadcast(norm)).select("id", (F.col("score") / F.coalesce(F.nullif("norm", F.lit(0.0)), F.lit(1.0))).alias("score"))

    ranks, done = _iterate(step, kg.nodes.select("id", F.lit(1.0 / max(n, 1)).alias("score")), rounds, tolerance, n)
    if not done:
        raise ArithmeticError(f"power iteration did not converge in {rounds} rounds")
    return ranks


METRICS: dict[str, Callable[[KG], DataFrame]] = {
    "degree": degree_centrality, "closeness": closeness, "betweenness": betweenness, "eigenvector": eigenvector, "pagerank": pagerank,
}


def sort_by_metric(kg: KG, metric: str | Column = "degree", limit: int | None = None, descending: bool = True) -> DataFrame:
    """Entities with ``score``, ordered by a named metric or a column expression over entities; ties by ``ord``."""
    if isinstance(metric, Column):
        scored = kg.nodes.withColumn("score", metric)
    else:
        scored = kg.nodes.join(METRICS.get(metric, degree_centrality)(kg), "id")
    scored = scored.orderBy(F.desc("score") if descending else F.asc("score"), "ord")
    return scored.limit(limit) if limit else scored


def stats(kg: KG, with_paths: bool = False) -> DataFrame:
    """One row: counts, density, connectedness, average clustering and, if asked for, the average path length."""
    arcs = durable(kg.arcs, "arcs")
    n, m = kg.nodes.agg(F.count(F.lit(1)).alias("nodes")), arcs.agg(F.count(F.lit(1)).alias("edges"))
    rels = kg.rels.agg(F.count(F.lit(1)).alias("relationships"))
    parts = components(kg, arcs).agg(F.countDistinct("component").alias("components"))
    mean = clustering(kg, arcs).agg(F.avg("score").alias("average_clustering"))
    paths = average_path_length(kg) if with_paths else kg.entities.sparkSession.range(1).select(F.lit(None).cast("double").alias("average"))
    density = F.when(F.col("nodes") <= 1, 0.0).otherwise(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)))
    row = n.crossJoin(m).crossJoin(rels).crossJoin(parts).crossJoin(mean).crossJoin(paths)
    return row.select("nodes", "edges", "relationships", density.alias("density"), (F.col("components") == 1).alias("connected"), "components", "average_clustering", F.col("average").alias("average_path_length"))
