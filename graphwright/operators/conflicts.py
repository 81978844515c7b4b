"""Conflict detection and resolution."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.operators import rules
from graphwright.operators.graph import KG
from graphwright.operators.traverse import all_cycles
from graphwright.plans.durable import durable


def contradictions(kg: KG, least: float = 0.5, strict: bool = False) -> DataFrame:
    """Relationships of opposite types between the same entities, each pair in both orders."""
    table = rules.pair_frame(kg.entities.sparkSession, rules.opposite_pairs(rules.REASONER_OPPOSITES), "type1", "type2")
    sure = kg.rels.where(F.col("confidence") >= least).select(
        "id", "source_entity", "target_entity", rules.canonical_type(F.col("relation_type"), strict).alias("type"), "confidence", "ord"
    )
    first = sure.withColumnsRenamed({"id": "id1", "type": "type1", "confidence": "c1", "ord": "ord1"}).join(table, "type1")
    second = sure.withColumnsRenamed({"id": "id2", "type": "type2", "confidence": "c2", "ord": "ord2"})
    return first.join(second, ["source_entity", "target_entity", "type2"]).where("id1 <> id2").select(
        "id1", "id2", "source_entity", "target_entity", "type1", "type2", F.lit("high").alias("severity"),
        F.least("c1", "c2").alias("confidence"), "c1", "c2", "ord1", "ord2",
    )


#: Entities of a unit of one attribute value, and parts that the meetings of a name's units are dealt to.
UNIT, SALTS = 64, 4


def property_conflicts(kg: KG, least: float = 0.5) -> DataFrame:
    """Entities of one name and type whose common attributes differ: one row per unordered pair and attribute.

    Every pair is a row.  Entities of one value are gathered in units of about ``UNIT`` at most, units of different
    values meet once, and only then their entities are paired.
    """
    group = ["name", "entity_type", "key"]
    cores = 4 * kg.entities.sparkSession.sparkContext.defaultParallelism
    sure = kg.nodes.where((F.col("confidence") >= least) & F.col("ord").isNotNull())
    values = sure.select("id", "name", "entity_type", "confidence", "ord", F.explode("attributes").alias("key", "value")).where("value is not null")
    counts = values.groupBy(*group, "value").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("parts"))
    # Only attributes on which entities of a name differ are compared.
    mixed = counts.groupBy(*group).agg(F.min("value").alias("low"), F.max("value").alias("high")).where("low <> high").select(*group)
    counts = durable(counts.join(mixed, group, "left_semi"), "values")
    placed = values.join(counts, [*group, "value"]).withColumn("part", F.pmod(F.xxhash64("id", "ord"), "parts"))
    units = durable(placed.groupBy(*group, "value", "part").agg(F.collect_list(F.struct("id", "confidence", "ord")).alias("members")), "units")
    place = [*group, "salt"]
    one = units.withColumnsRenamed({"value": "v1", "members": "members1"}).withColumn("salt", F.pmod(F.xxhash64("v1", "part"), F.lit(SALTS)).cast("int")).drop("part")
    two = units.drop("part").withColumnsRenamed({"value": "v2", "members": "members2"}).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = one.repartition(cores, *place).join(two.repartition(cores, *place).hint("merge"), place).where("v1 < v2")
    # As many parts as there are, so nothing moves: it only ends the generated loop, which would hold all pairs of a unit at once.
    met = met.select(*group, "v1", "v2", "members1", "members2").coalesce(cores)
    both = met.select(*group, "v1", "v2", F.explode("members1").alias("a"), "members2").select(*group, "v1", "v2", "a", F.explode("members2").alias("b"))
    first = (F.col("a.ord") < F.col("b.ord")) | ((F.col("a.ord") == F.col("b.ord")) & (F.col("a.id") < F.col("b.id")))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return both.where("a.ord <> b.ord or a.id <> b.id").select(
        pick("a.id", "b.id").alias("id1"), pick("b.id", "a.id").alias("id2"), *group, pick("v1", "v2").alias("value1"), pick("v2", "v1").alias("value2"), F.lit("medium").alias("severity"),
        F.least("a.confidence", "b.confidence").alias("confidence"), pick("a.confidence", "b.confidence").alias("confidence1"), pick("b.confidence", "a.confidence").alias("confidence2"),
        pick("a.ord", "b.ord").alias("ord1"), pick("b.ord", "a.ord").alias("ord2"),
    )


def circular_hierarchies(kg: KG, least: float = 0.5, longest: int = 4, strict: bool = False) -> DataFrame:
    """Cycles in is-a, part-of and contains, each from its least entity: ``(relation_type, start, nodes, length, severity, confidence)``.

    All elementary ones of 2 to ``longest`` edges (there can be exponentially many longer ones), and one
    shortest of every component that has only longer ones, so that no cyclic component is missed.
    """
    typed = kg.rels.where(F.col("confidence") >= least).withColumn("__type", rules.canonical_type(F.col("relation_type"), strict))
    edges = typed.where(F.col("__type").isin(*rules.HIERARCHY)).select(F.col("__type").alias("kind"), F.col("source_entity").alias("s"), F.col("target_entity").alias("t")).distinct()
    found = all_cycles(edges, longest)
    return found.select(
        F.col("kind").alias("relation_type"), "start", "nodes", "length", F.lit("high").alias("severity"), F.lit(0.9).cast("double").alias("confidence")
    )


def detect_conflicts(kg: KG, least: float = 0.5, longest: int = 4) -> DataFrame:
    """All conflicts as ``(type, elements, severity, confidence, explanation)``."""
    a = contradictions(kg, least).select(
        F.lit("contradictory_relationship").alias("type"), F.array("id1", "id2").alias("elements"), "severity", "confidence",
        F.concat(F.lit("Contradictory relationships: "), "type1", F.lit(" and "), "type2").alias("explanation"),
    )
    b = property_conflicts(kg, least).groupBy("id1", "id2", "name", "severity", "confidence").agg(F.array_sort(F.collect_set("key")).alias("keys")).select(
        F.lit("property_conflict").alias("type"), F.array("id1", "id2").alias("elements"), "severity", "confidence",
        F.concat(F.lit("Different values of "), F.array_join("keys", ", "), F.lit(" for "), "name").alias("explanation"),
    )
    c = circular_hierarchies(kg, least, longest).select(
        F.lit("circular_hierarchy").alias("type"), F.col("nodes").alias("elements"), "severity", "confidence",
        F.concat(F.lit("Cycle of "), "relation_type").alias("explanation"),
    )
    return a.unionByName(b).unionByName(c)


def property_conflict_pairs(kg: KG, least: float = 0.5) -> DataFrame:
    """One row ``(n)``: the number of entity pairs that :func:`property_conflicts` has a row for.

    Pairs are not listed, as there can be a square of them: of all pairs of a name and type those that agree are
    taken off.  Entities with the same attributes agree if all values are equal; two sets of attributes are compared on the
    common ones.  So the work grows with the entities, and with the pairs of attribute sets that one name has.
    """
    group = ["name", "entity_type"]
    known = F.map_filter("attributes", lambda _, v: v.isNotNull())
    sure = kg.nodes.where((F.col("confidence") >= least) & F.col("name").isNotNull() & F.col("entity_type").isNotNull()).select(*group, known.alias("known")).where(F.size("known") > 0)
    sure = sure.withColumn("keys", F.array_sort(F.map_keys("known")))
    values = lambda keys: F.transform(keys, lambda k: F.element_at("known", k))
    classes = durable(sure.groupBy(*group, "keys", values("keys").alias("values")).agg(F.count(F.lit(1)).alias("n")), "classes")
    every = classes.groupBy(*group).agg(F.sum("n").alias("n")).select(_pairs_of("n").alias("n"))
    equal = classes.select((-_pairs_of("n")).alias("n"))
    sets = classes.select(*group, "keys").distinct()
    mixed = sets.withColumnRenamed("keys", "keys1").join(sets.withColumnRenamed("keys", "keys2"), group).where("keys1 < keys2")

    def projected(n: int) -> DataFrame:
        """Entities of one of two sets by their values of the common attributes."""
        both = classes.withColumnRenamed("keys", f"keys{n}").join(mixed, [*group, f"keys{n}"])
        common = F.array_sort(F.array_intersect("keys1", "keys2"))
        shared = F.transform(common, lambda k: F.element_at(F.map_from_arrays(f"keys{n}", "values"), k))
        return both.groupBy(*group, "keys1", "keys2", shared.alias("shared")).agg(F.sum("n").alias(f"n{n}"))

    across = projected(1).join(projected(2), [*group, "keys1", "keys2", "shared"]).select((-(F.col("n1") * F.col("n2"))).alias("n"))
    return every.unionByName(equal).unionByName(across).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _pairs_of(n: str) -> Column:
    return F.expr(f"{n} * ({n} - 1) div 2")


def conflict_counts(kg: KG, least: float = 0.5, longest: int = 4) -> DataFrame:
    """``(type, severity, n)``: how many rows of each kind :func:`detect_conflicts` has; kinds without one are left out."""
    count = F.count(F.lit(1)).alias("n")
    a = contradictions(kg, least).groupBy(F.lit("contradictory_relationship").alias("type"), "severity").agg(count)
    b = property_conflict_pairs(kg, least).where("n > 0").select(F.lit("property_conflict").alias("type"), F.lit("medium").alias("severity"), "n")
    c = circular_hierarchies(kg, least, longest).groupBy(F.lit("circular_hierarchy").alias("type"), "severity").agg(count)
    return a.unionByName(b).unionByName(c)


def action_counts(kg: KG, least: float = 0.5, longest: int = 4) -> DataFrame:
    """``(action_type, n)``: how many actions of each kind :func:`resolve_conflicts` takes; kinds without one are left out.

    Attributes are merged once for each pair of entities in conflict.
    """
    count = F.count(F.lit(1)).alias("n")
    a = contradiction_actions(contradictions(kg, least)).groupBy("action_type").agg(count)
    b = property_conflict_pairs(kg, least).where("n > 0").select(F.lit("merge_entity_attributes").alias("action_type"), "n")
    c = cycle_actions(kg, circular_hierarchies(kg, least, longest)).groupBy(F.lit("break_cycle").alias("action_type")).agg(count)
    return a.unionByName(b).unionByName(c)


def contradiction_actions(conflicts: DataFrame) -> DataFrame:
    """Per conflict record the relationship to keep (higher confidence; a tie keeps the first listed) and the one to remove."""
    keep_first = F.col("c1") >= F.col("c2")
    return conflicts.select(
        F.lit("remove_relationship").alias("action_type"), F.when(keep_first, F.col("id1")).otherwise(F.col("id2")).alias("kept"),
        F.when(keep_first, F.col("id2")).otherwise(F.col("id1")).alias("removed"),
    )


def resolve_contradictions(kg: KG, conflicts: DataFrame | None = None, least: float = 0.5) -> KG:
    """Remove the less certain relationship of each contradicting pair.

    Both orders of a pair of equal confidence would remove both sides; as the
    second record finds one side gone already, the earlier inserted one is kept.
    """
    found = contradictions(kg, least) if conflicts is None else conflicts
    once = found.where("ord1 < ord2 or (ord1 = ord2 and id1 < id2)")
    gone = contradiction_actions(once).select(F.col("removed").alias("id")).distinct()
    return replace(kg, entities=kg.nodes, relationships=kg.rels.join(gone, "id", "left_anti"), unique=True)


def resolve_property_conflicts(kg: KG, conflicts: DataFrame | None = None, least: float = 0.5) -> KG:
    """Overwrite conflicting attributes with the value of the most certain entity of the pair.

    An entity in several conflicts about one attribute takes the value of the most
    certain of its opponents (then the earliest).
    """
    found = property_conflicts(kg, least) if conflicts is None else conflicts
    first = F.col("confidence1") >= F.col("confidence2")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    updates = found.select(pick("id2", "id1").alias("id"), "key", pick("value1", "value2").alias("value"), pick("confidence1", "confidence2").alias("c"), pick("ord1", "ord2").alias("o"))
    best = updates.groupBy("id", "key").agg(F.max_by("value", F.struct("c", -F.col("o"))).alias("value"))
    new = best.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("__new"))
    merged = F.map_concat(F.map_filter("attributes", lambda k, _: ~F.array_contains(F.map_keys("__new"), k)), F.col("__new"))
    nodes = kg.nodes.join(new, "id", "left").withColumn("attributes", F.when(F.col("__new").isNull(), F.col("attributes")).otherwise(merged))
    return replace(kg, entities=nodes.select(*kg.nodes.columns), relationships=kg.rels, unique=True)


def cycle_actions(kg: KG, cycles: DataFrame, strict: bool = False) -> DataFrame:
    """Per cycle its least certain relationship of that type (ties: the earliest): ``(start, relation_type, nodes, removed)``."""
    following = F.transform(F.sequence(F.lit(1), F.col("length")), lambda i: F.struct(
        F.element_at("nodes", i).alias("s"), F.element_at("nodes", (i % F.col("length")) + 1).alias("t")))
    hops = cycles.select("relation_type", "start", "nodes", F.explode(following).alias("e")).select("relation_type", "start", "nodes", "e.s", "e.t")
    rels = kg.rels.select("id", F.col("source_entity").alias("s"), F.col("target_entity").alias("t"), rules.canonical_type(F.col("relation_type"), strict).alias("relation_type"), "confidence", "ord")
    inside = hops.join(rels, ["relation_type", "s", "t"])
    return inside.groupBy("relation_type", "start", "nodes").agg(F.min_by("id", F.struct("confidence", "ord")).alias("removed"))


def resolve_cycles(kg: KG, least: float = 0.5, longest: int = 4) -> KG:
    """Remove the least certain relationship of every cycle, until no cycle of any length is left.

    A pair linked by several relationships of a type keeps its cycle until the last of them is gone.
    """
    gone = None
    while True:
        here = kg if gone is None else replace(kg, entities=kg.nodes, relationships=kg.rels.join(gone, "id", "left_anti"), unique=True)
        more = durable(cycle_actions(here, circular_hierarchies(here, least, longest)).select(F.col("removed").alias("id")).distinct(), "gone")
        if more.isEmpty():
            return here
        gone = more if gone is None else durable(gone.unionByName(more), "gone", replaces=gone)


def resolve_conflicts(kg: KG, least: float = 0.5, longest: int = 4) -> tuple[DataFrame, KG]:
    """(actions, graph) after resolving contradictions, property conflicts and cycles."""
    found, props, cycles = contradictions(kg, least), property_conflicts(kg, least), circular_hierarchies(kg, least, longest)
    first = F.col("confidence1") >= F.col("confidence2")
    merged = props.select(
        F.lit("merge_entity_attributes").alias("action_type"), F.when(first, F.col("id1")).otherwise(F.col("id2")).alias("kept"),
        F.when(first, F.col("id2")).otherwise(F.col("id1")).alias("removed"),
    ).distinct()
    broken = cycle_actions(kg, cycles).select(F.lit("break_cycle").alias("action_type"), F.col("start").alias("kept"), "removed")
    # The actions are those on the cycles found; the graph is rid of all.
    actions = contradiction_actions(found).unionByName(merged).unionByName(broken)
    out = resolve_property_conflicts(resolve_contradictions(kg, found), props)
    return actions, resolve_cycles(out, least, longest)


def strongest_per_pair(kg: KG) -> DataFrame:
    """Per (source, target) the most certain relationship (ties: the earliest)."""
    place = Window.partitionBy("source_entity", "target_entity").orderBy(F.desc("confidence"), "ord")
    return kg.rels.withColumn("__n", F.row_number().over(place)).where("__n = 1").drop("__n")
