"""Verification: dangling references, cycles, contradictions; all rules always run."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.functions.text import outermost_json
from graphwright.operators import rules
from graphwright.operators.provider import Provider
from graphwright.operators.traverse import all_cycles
from graphwright.plans.durable import durable
from graphwright.schema import ISSUES


def dangling_references(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """``(id, endpoint, missing)``: one row per endpoint that is not an entity."""
    ids = entities.select(F.col("id").alias("missing")).distinct()
    side = lambda c, name: relationships.select("id", F.lit(name).alias("endpoint"), F.col(c).alias("missing")).join(ids, "missing", "left_anti")
    return side("source_entity", "source").unionByName(side("target_entity", "target")).select("id", "endpoint", "missing")


def contradictory_types(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """``(id1, id2, source_entity, target_entity, type1, type2)``: opposite types on one pair of known entities.

    Case-sensitive; a bidirectional relationship is also read backwards; each pair of
    relationships once per direction, the earlier one first.
    """
    table = rules.pair_frame(entities.sparkSession, rules.opposite_pairs(rules.VERIFIER_OPPOSITES), "type1", "type2")
    forward = relationships.select("id", "source_entity", "target_entity", "relation_type", "ord", "bidirectional")
    back = forward.where("bidirectional").select("id", F.col("target_entity").alias("source_entity"), F.col("source_entity").alias("target_entity"), "relation_type", "ord", "bidirectional")
    listed = forward.unionByName(back).drop("bidirectional").distinct()
    ids = entities.select("id").distinct()
    for c in ("source_entity", "target_entity"):
        listed = listed.join(ids.withColumnRenamed("id", c), c, "left_semi")
    first = listed.withColumnsRenamed({"id": "id1", "relation_type": "type1", "ord": "ord1"}).join(table, "type1")
    second = listed.withColumnsRenamed({"id": "id2", "relation_type": "type2", "ord": "ord2"})
    both = first.join(second, ["source_entity", "target_entity", "type2"]).where("ord1 < ord2 or (ord1 = ord2 and id1 < id2)")
    return both.select("id1", "id2", "source_entity", "target_entity", "type1", "type2")


def hierarchy_cycles(relationships: DataFrame, longest: int = 4) -> DataFrame:
    """Cycles in the union of the hierarchical types: ``(start, nodes, length)``.

    Each of up to ``longest`` edges once from its least entity; a component whose cycles are all
    longer is reported by one of its shortest, so that no cyclic component is missed.
    """
    edges = relationships.where(F.lower("relation_type").isin(*rules.VERIFIER_HIERARCHY)).select(
        F.lit("hierarchy").alias("kind"), F.col("source_entity").alias("s"), F.col("target_entity").alias("t")
    )
    return all_cycles(edges.distinct(), longest).select("start", "nodes", "length")


def transitive_contradictions(relationships: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(relation_type, source_entity, target_entity, distance, contradiction)``.

    Pairs denied by a direct relationship although the target is reached over two
    or more edges of one hierarchical type (up to ``max_hops``, if given).  Only sources of a
    denial are searched, level by level, each reached entity once, until a level is empty.
    """
    kind = F.lower("relation_type")
    denial = relationships.where(kind.isin(*rules.VERIFIER_DENIALS)).select("source_entity", "target_entity", F.col("id").alias("contradiction"))
    step = relationships.where(kind.isin(*rules.VERIFIER_TRANSITIVE)).select(kind.alias("kind"), F.col("source_entity").alias("node"), F.col("target_entity").alias("to")).distinct()
    starts = denial.select(F.col("source_entity").alias("start")).distinct()
    level = starts.join(step.withColumnRenamed("node", "start"), "start").where("start <> to").select("kind", "start", F.col("to").alias("node"), F.lit(1).alias("distance")).distinct()
    seen = level = durable(level, "level")
    distance = 1
    while not level.isEmpty() and (max_hops is None or distance < max_hops):
        distance += 1
        onward = level.join(step, ["kind", "node"]).where("start <> to").select("kind", "start", F.col("to").alias("node")).distinct()
        level = durable(onward.join(seen, ["kind", "start", "node"], "left_anti").withColumn("distance", F.lit(distance)), "level")
        seen = seen.unionByName(level)
    return seen.where("distance >= 2").join(denial, (F.col("start") == F.col("source_entity")) & (F.col("node") == F.col("target_entity"))).select(
        F.col("kind").alias("relation_type"), "source_entity", "target_entity", "distance", "contradiction"
    )


def verify(entities: DataFrame, relationships: DataFrame, longest_cycle: int = 4, max_hops: int | None = None) -> DataFrame:
    """All issues in the shape of ``graphwright.schema.ISSUES``."""
    empty = F.create_map().cast("map<string,string>")
    names = entities.select("id", "name")
    dangling = dangling_references(entities, relationships).select(
        F.lit("dangling_reference").alias("issue_type"), F.array("id").alias("involved_elements"),
        F.concat(F.lit("Add the missing "), "endpoint", F.lit(" entity "), "missing", F.lit(" or remove the relationship")).alias("proposed_solution"),
        F.lit("critical").alias("severity"), F.create_map(F.lit("missing_entity"), "missing").alias("metadata"),
    )
    cycles = hierarchy_cycles(relationships, longest_cycle).select(
        F.lit("cyclic_dependency").alias("issue_type"), F.col("nodes").alias("involved_elements"),
        F.concat(F.lit("Remove one relationship of the cycle "), F.array_join("nodes", " -> ")).alias("proposed_solution"),
        F.lit("critical").alias("severity"), empty.alias("metadata"),
    )
    named = contradictory_types(entities, relationships)
    for c, n in (("source_entity", "source_name"), ("target_entity", "target_name")):
        named = named.join(names.withColumnsRenamed({"id": c, "name": n}), c)
    opposed = named.select(
        F.lit("contradictory_relationships").alias("issue_type"), F.array("id1", "id2").alias("involved_elements"),
        F.concat(F.lit("Decide between "), "type1", F.lit(" and "), "type2", F.lit(" for "), "source_name", F.lit(" and "), "target_name").alias("proposed_solution"),
        F.lit("medium").alias("severity"), F.create_map(F.lit("source_entity"), "source_entity", F.lit("target_entity"), "target_entity").alias("metadata"),
    )
    indirect = transitive_contradictions(relationships, max_hops).select(
        F.lit("transitive_contradiction").alias("issue_type"), F.array("contradiction").alias("involved_elements"),
        F.concat(F.lit("Resolve the denial of the implied "), "relation_type", F.lit(" relationship")).alias("proposed_solution"),
        F.lit("medium").alias("severity"), F.create_map(F.lit("source_entity"), "source_entity", F.lit("target_entity"), "target_entity").alias("metadata"),
    )
    return dangling.unionByName(cycles).unionByName(opposed).unionByName(indirect)


def is_valid(issues: DataFrame) -> DataFrame:
    """One row ``(is_valid, issues)``: valid without critical issues."""
    return issues.agg((F.count_if(F.col("severity") == "critical") == 0).alias("is_valid"), F.count(F.lit(1)).alias("issues"))


def parse_issues(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Issues out of model answers: the outermost list, else the outermost object; rows without a type are skipped."""
    shape = "issue_type string, involved_elements array<string>, proposed_solution string, severity string"
    many = F.from_json(outermost_json(F.col(column), array=True), f"array<struct<{shape.replace(' string', ': string').replace(' array', ': array')}>>")
    one = F.from_json(outermost_json(F.col(column)), shape)
    rows = answers.select(F.explode(F.coalesce(many, F.array(one))).alias("i")).where("i.issue_type is not null")
    severity = F.lower(F.coalesce("i.severity", F.lit("medium")))
    return rows.select(
        "i.issue_type", F.coalesce("i.involved_elements", F.array().cast("array<string>")).alias("involved_elements"), F.coalesce("i.proposed_solution", F.lit("")).alias("proposed_solution"),
        F.when(severity.isin("critical", "medium", "low"), severity).otherwise("medium").alias("severity"), F.create_map().cast("map<string,string>").alias("metadata"),
    ).to(answers.sparkSession.createDataFrame([], ISSUES).schema)


def entity_lines(entities: DataFrame) -> DataFrame:
    """Prompt text of every entity: ``(id, ord, line)``."""
    return entities.select("id", "ord", F.concat(F.lit("- ["), "id", F.lit("] "), "name", F.lit(" ("), "entity_type", F.lit(")")).alias("line"))


def relationship_lines(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Prompt text of every relationship between known entities: ``(id, ord, line)``."""
    rows = relationships
    for c, n in (("source_entity", "source_name"), ("target_entity", "target_name")):
        rows = rows.join(entities.select(F.col("id").alias(c), F.col("name").alias(n)), c)
    return rows.select("id", "ord", F.concat(F.lit("- ["), "id", F.lit("] "), "source_name", F.lit(" --"), "relation_type", F.lit("--> "), "target_name").alias("line"))


def verify_with_model(entities: DataFrame, relationships: DataFrame, provider: Callable[[], Provider], lines: int = 200) -> DataFrame:
    """Issues that a model finds in blocks of about ``lines`` relationships and the entities they name.

    The rules of :func:`verify` do not depend on it; a provider's failure fails this
    pass alone.
    """
    texts = relationship_lines(entities, relationships)
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(relationships.count()) / lines)).cast("int")
    prompts = texts.groupBy(F.pmod(F.xxhash64("id"), blocks).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for batch in batches:
            yield pd.DataFrame({"answer": [json.dumps(model.generate_json(p, {"task": "verify"})) for p in batch["prompt"]]})

    return parse_issues(prompts.select("prompt").mapInPandas(run, "answer string"))
