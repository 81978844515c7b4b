"""Inference: symmetric, inverse, chained and transitive relationships; path reasoning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.operators import rules
from graphwright.operators.graph import KG, latest
from graphwright.operators.traverse import find_paths, path_steps

_COLUMNS = [
    "type", "relation_type", "source_entity", "target_entity", "source_name", "target_name", "confidence", "paths_count",
    "based_on_relationship", "explanation",
]


def _typed(kg: KG, strict: bool) -> DataFrame:
    return kg.rels.select(
        "id", F.col("source_entity").alias("s"), F.col("target_entity").alias("t"), "relation_type",
        rules.canonical_type(F.col("relation_type"), strict).alias("type"), "confidence", "ord",
    )


def _named(kg: KG, found: DataFrame) -> DataFrame:
    names = kg.nodes.select("id", "name")
    for end, name in (("source_entity", "source_name"), ("target_entity", "target_name")):
        found = found.join(names.withColumnsRenamed({"id": end, "name": name}), end)
    if "explanation" not in found.columns:
        text = F.concat(F.lit("Inferred "), "relation_type", F.lit(": "), "source_name", F.lit(" -> "), "target_name")
        found = found.withColumn("explanation", text)
    for column, kind in (("paths_count", "bigint"), ("based_on_relationship", "string")):
        if column not in found.columns:
            found = found.withColumn(column, F.lit(None).cast(kind))
    return found.select(*_COLUMNS)


def infer_symmetric(kg: KG, least: float = 0.7, strict: bool = False) -> DataFrame:
    """The missing reverse of symmetric relationships, at 0.95 of their confidence."""
    typed = _typed(kg, strict).where(F.col("type").isin(*rules.SYMMETRIC))
    # The reverse must have the same spelling of the type; its confidence does not matter.
    there = typed.select(F.col("s").alias("t"), F.col("t").alias("s"), "type").distinct()
    found = typed.where(F.col("confidence") >= least).join(there, ["s", "t", "type"], "left_anti")
    return _named(kg, found.select(
        F.lit("symmetric_relationship").alias("type"), "relation_type", F.col("t").alias("source_entity"), F.col("s").alias("target_entity"),
        (F.col("confidence") * 0.95).alias("confidence"), F.col("id").alias("based_on_relationship"),
    ))


def infer_inverse(kg: KG, least: float = 0.7, strict: bool = False) -> DataFrame:
    """The missing inverse (contains / part-of and so on), at 0.95 of the confidence."""
    table = rules.pair_frame(kg.entities.sparkSession, rules.inverse_pairs(), "type", "inverse")
    typed = _typed(kg, strict).join(table, "type")
    there = _typed(kg, strict).select(F.col("s").alias("t"), F.col("t").alias("s"), F.col("type").alias("inverse")).distinct()
    found = typed.where(F.col("confidence") >= least).join(there, ["s", "t", "inverse"], "left_anti")
    return _named(kg, found.select(
        F.lit("inverse_relationship").alias("type"), F.col("inverse").alias("relation_type"), F.col("t").alias("source_entity"),
        F.col("s").alias("target_entity"), (F.col("confidence") * 0.95).alias("confidence"), F.col("id").alias("based_on_relationship"),
    ))


def infer_chained(kg: KG, least: float = 0.7, strict: bool = False) -> DataFrame:
    """has-skill followed by required-for gives qualified-for; one row per chain."""
    first, second, inferred = rules.CHAIN
    sure = _typed(kg, strict).where(F.col("confidence") >= least)
    skills = sure.where(F.col("type") == first).select("s", F.col("t").alias("via"), F.col("confidence").alias("c1"))
    needs = sure.where(F.col("type") == second).select(F.col("s").alias("via"), "t", F.col("confidence").alias("c2"))
    found = skills.join(needs, "via").withColumn("confidence", F.col("c1") * F.col("c2") * 0.9).where(F.col("confidence") >= least)
    return _named(kg, found.select(
        F.lit("transitive_relationship").alias("type"), F.lit(inferred).alias("relation_type"), F.col("s").alias("source_entity"),
        F.col("t").alias("target_entity"), "confidence",
    ))


def infer_transitive(kg: KG, least: float = 0.7, strict: bool = False, hops: int = 3, types: tuple[str, ...] = rules.TRANSITIVE) -> DataFrame:
    """Pairs joined by simple paths of 2 to ``hops`` edges of one transitive type, without a direct edge of that type.

    A path's confidence is the product of its edges' times 0.9 per hop; the best
    path counts, and must reach ``least``.  Parallel edges of a type collapse to the
    last written.  Pairs that have a direct edge are removed after the paths of
    each length are aggregated, so the join volume is that of the paths only.
    """
    typed = _typed(kg, strict).where(F.col("type").isin(*types))
    edges = latest(typed, ["type", "s", "t"], ["ord"]).where("s <> t").select("type", "s", "t", "confidence")
    step = edges.select("type", F.col("s").alias("end"), F.col("t").alias("to"), F.col("confidence").alias("c"))
    paths = edges.select("type", "s", F.col("t").alias("end"), F.col("confidence").alias("product"), F.array("s", "t").alias("seen"))
    scores = []
    for hop in range(2, hops + 1):
        paths = paths.join(step, ["type", "end"]).where(~F.array_contains("seen", F.col("to"))).select(
            "type", "s", F.col("to").alias("end"), (F.col("product") * F.col("c")).alias("product"), F.array_append("seen", F.col("to")).alias("seen")
        )
        scores.append(paths.select("type", "s", "end", (F.col("product") * (0.9**hop)).alias("confidence")))
    found = scores[0]
    for more in scores[1:]:
        found = found.unionByName(more)
    found = found.groupBy("type", "s", "end").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("paths_count"))
    found = found.where(F.col("confidence") >= least).join(edges.select("type", "s", F.col("t").alias("end")), ["type", "s", "end"], "left_anti")
    return _named(kg, found.select(
        F.lit("transitive_relationship").alias("type"), F.col("type").alias("relation_type"), F.col("s").alias("source_entity"),
        F.col("end").alias("target_entity"), "confidence", "paths_count",
    ))


def infer_new_relationships(kg: KG, least: float = 0.7, strict: bool = False) -> DataFrame:
    """All four kinds of inference."""
    parts = [infer(kg, least, strict) for infer in (infer_chained, infer_transitive, infer_symmetric, infer_inverse)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def path_inferences(steps: DataFrame, strict: bool = False, prefix_only: bool = False) -> DataFrame:
    """Inferences along paths given as ``(path_id, step, node, rel_id, relation_type, confidence)``.

    ``rel_id`` leads into ``node`` (null at step 0).  Every two consecutive hops are
    examined; ``prefix_only`` looks at the first two of each path alone.  A path of
    more than three nodes that ends where it began is reported as circular.
    """
    hop = steps.withColumn("rtype", rules.canonical_type(F.col("relation_type"), strict))
    a = hop.where("step >= 1").select("path_id", "step", F.col("rtype").alias("t1"), F.col("confidence").alias("c1"))
    b = hop.where("step >= 2").select("path_id", (F.col("step") - 1).alias("step"), F.col("rtype").alias("t2"), F.col("confidence").alias("c2"), F.col("node").alias("target_entity"))
    start = hop.select("path_id", (F.col("step") + 1).alias("step"), F.col("node").alias("source_entity"))
    pairs = a.join(b, ["path_id", "step"]).join(start, ["path_id", "step"])
    if prefix_only:
        pairs = pairs.where("step = 1")
    first, second, inferred = rules.CHAIN
    kind = F.when((F.col("t1") == first) & (F.col("t2") == second), inferred).when(
        (F.col("t1") == F.col("t2")) & F.col("t1").isin(*rules.PATH_TRANSITIVE), F.col("t1")
    )
    found = pairs.select(
        F.lit("transitive_inference").alias("type"), kind.alias("relation_type"), "source_entity", "target_entity",
        (F.least("c1", "c2") * 0.9).alias("confidence"),
    ).where("relation_type is not null")
    ends = steps.groupBy("path_id").agg(F.min_by("node", "step").alias("a"), F.max_by("node", "step").alias("b"), F.count(F.lit(1)).alias("n"))
    circular = ends.where("n > 3 and a = b").select(
        F.lit("circular_reasoning").alias("type"), F.lit(None).cast("string").alias("relation_type"), F.col("a").alias("source_entity"),
        F.col("b").alias("target_entity"), F.lit(0.7).cast("double").alias("confidence"),
    )
    return found.unionByName(circular)


def reason_over_path(kg: KG, source: str, target: str, max_depth: int = 5, strict: bool = False, prefix_only: bool = False) -> DataFrame:
    """Inferences along the first paths from ``source`` to ``target``; no path gives no rows."""
    return path_inferences(path_steps(kg, find_paths(kg, source, target, max_depth)), strict, prefix_only)
