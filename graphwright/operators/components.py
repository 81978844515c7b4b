"""Connected components by randomised contraction: joins and aggregates only, linear space per round."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.plans.durable import durable
from graphwright.plans.skew import HOT, attach

#: Edges that one task may finish on its own once the rounds have left so few; a constant, whatever the input.
FEW = 4096
#: Edges from which a hub is joined apart from the other nodes.
LARGE = 100_000


def _finish(edges: DataFrame) -> DataFrame:
    """``(u, r, n)``: roots of the nodes of at most ``few`` edges by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sorted((find(u), find(v)))
                parent[b] = a
        if parent:
            nodes = list(parent)
            columns = [pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind), pa.array([1] * len(nodes), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "r", "n"])

    name = dict(edges.dtypes)["u"]
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]
    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"u {name}, r {name}, n long")


def _joined(edges: DataFrame, rep: DataFrame, key: str, out: str, hubs: bool) -> DataFrame:
    facts = rep.select(F.col("u").alias(key), F.col("r").alias(out), "n")
    return attach(edges, facts, key, "n") if hubs else edges.join(facts.drop("n"), key)


def contract_components(edges: DataFrame, src: str = "u", dst: str = "v", few: int = FEW) -> DataFrame:
    """Label the nodes of an undirected edge list.

    Returns ``(node, root)``: one row per node that has an edge to another node;
    nodes of one component share ``root`` (one of them, not necessarily the least).
    Null endpoints and self-loops are ignored; an empty input gives no rows.

    Every round each node adopts the neighbour (or itself) with the least seeded
    hash, and then what that one adopted; edges are re-pointed and de-duplicated, so
    the edge set shrinks by a constant factor in expectation and long chains also take
    O(log n) rounds.  The minimum is a partial aggregate and hubs are joined apart
    (:func:`graphwright.plans.skew.attach`), so a hub is not gathered anywhere.  Once
    ``few`` edges are left, one task finishes them.
    """
    edges = durable(
        edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    maps: list[DataFrame] = []
    while left := edges.count():
        if left <= few and dict(edges.dtypes)["u"] in ("bigint", "int", "string"):
            maps.append(durable(_finish(edges), "rep", replaces=edges))
            break
        h = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))).alias("h"), F.col(c).alias("x"))  # noqa: E731,B023
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(h("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        near = durable(near.select("u", F.least(F.col("m"), h("u")).getField("x").alias("r"), "n"), "near")
        # Every r is a node of the same table, whose own choice is adopted instead: one more hop for one more join.
        choice = near.groupBy("r").agg(F.count(F.lit(1)).alias("n")).join(near.select(F.col("u").alias("r"), F.col("r").alias("rr")), "r")
        hubs = left > LARGE and not near.where(F.col("n") > HOT * left).isEmpty()
        hopped = attach(near.select("u", "r", F.col("n").alias("deg")), durable(choice, "choice"), "r", "n") if hubs else near.withColumnRenamed("n", "deg").join(choice.drop("n"), "r")
        rep = durable(hopped.select("u", F.col("rr").alias("r"), F.col("deg").alias("n")), "rep", replaces=near)
        maps.append(rep)
        moved = _joined(_joined(edges, rep, "u", "ru", hubs), rep, "v", "rv", hubs).where("ru <> rv")
        edges = durable(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges", replaces=edges)
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    labels = maps[-1].select("u", "r")
    for rep in reversed(maps[:-1]):
        up = labels.select(F.col("u").alias("r"), F.col("r").alias("up"))
        labels = rep.select("u", "r").join(up, "r", "left").select("u", F.coalesce("up", "r").alias("r"))
    return labels.select(F.col("u").alias("node"), F.col("r").alias("root"))
