"""The graph: two tables, two adjacency views, lookups and set-based changes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row by ``order`` of every key, as one partial aggregate."""
    whole = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(whole).select("row.*")


@dataclass(frozen=True)
class KG:
    """An immutable property graph; every operator returns a new graph or a DataFrame.

    ``entities`` and ``relationships`` follow ``graphwright.schema``; ``ord`` stands for the
    order of insertion.  ``unique`` says that ids are known to be distinct and all
    endpoints known to exist, which saves the shuffles that establish it.
    """

    entities: DataFrame
    relationships: DataFrame
    name: str = "knowledge_graph"
    meta: dict[str, str] = field(default_factory=dict)
    unique: bool = False

    @cached_property
    def nodes(self) -> DataFrame:
        """Entities, the last one of each id."""
        return self.entities if self.unique else latest(self.entities, ["id"], ["ord"])

    @cached_property
    def rels(self) -> DataFrame:
        """Relationships between known entities, the last one of each id (a multigraph)."""
        if self.unique:
            return self.relationships
        return with_endpoints(latest(self.relationships, ["id"], ["ord"]), self.nodes)

    @cached_property
    def edges(self) -> DataFrame:
        """One directed edge per (source, target): the last written, bidirectional relationships in both directions."""
        forward = self.rels.select(
            "id", F.col("source_entity").alias("s"), F.col("target_entity").alias("t"), "relation_type", "strength",
            "confidence", "bidirectional", F.lit(False).alias("reverse"), "ord",
        )
        back = forward.where("bidirectional").select(
            F.concat("id", F.lit("_reverse")).alias("id"), F.col("t").alias("s"), F.col("s").alias("t"), "relation_type",
            "strength", "confidence", "bidirectional", F.lit(True).alias("reverse"), "ord",
        )
        return latest(forward.unionByName(back), ["s", "t"], ["ord", "reverse"])

    @property
    def arcs(self) -> DataFrame:
        """``(s, t)`` of :attr:`edges`, each once, without finding the last written one."""
        ends = self.rels.select(F.col("source_entity").alias("s"), F.col("target_entity").alias("t"), "bidirectional")
        both = F.when(F.col("bidirectional"), F.array(F.struct("s", "t"), F.struct(F.col("t").alias("s"), F.col("s").alias("t")))).otherwise(F.array(F.struct("s", "t")))
        return ends.select(F.inline(both)).distinct()

    def views(self, prefix: str = "") -> None:
        """Register ``entities``, ``relationships`` and ``edges`` as temporary views for Spark SQL."""
        self.nodes.createOrReplaceTempView(f"{prefix}entities")
        self.rels.createOrReplaceTempView(f"{prefix}relationships")
        self.edges.createOrReplaceTempView(f"{prefix}edges")

    # lookups

    def entity(self, id_: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id_)

    def relationship(self, id_: str) -> DataFrame:
        return self.rels.where(F.col("id") == id_)

    def relationships_between(self, source: str, target: str) -> DataFrame:
        return self.rels.where((F.col("source_entity") == source) & (F.col("target_entity") == target))

    def entity_relationships(self, id_: str) -> DataFrame:
        """Relationships with ``id_`` at either end; a self-loop once."""
        return self.rels.where((F.col("source_entity") == id_) | (F.col("target_entity") == id_))

    def outgoing(self, id_: str, types: list[str] | None = None) -> DataFrame:
        return self._typed(self.rels.where(F.col("source_entity") == id_), types)

    def incoming(self, id_: str, types: list[str] | None = None) -> DataFrame:
        return self._typed(self.rels.where(F.col("target_entity") == id_), types)

    def entities_by_type(self, entity_type: str) -> DataFrame:
        return self.nodes.where(F.col("entity_type") == entity_type)

    def relationships_by_type(self, relation_type: str) -> DataFrame:
        return self.rels.where(F.col("relation_type") == relation_type)

    @staticmethod
    def _typed(rels: DataFrame, types: list[str] | None) -> DataFrame:
        return rels.where(F.col("relation_type").isin(types)) if types else rels

    # changes

    def add_entities(self, rows: DataFrame) -> KG:
        """Upsert by id."""
        return replace(self, entities=latest(_after(self.entities, rows), ["id"], ["ord"]), unique=False)

    def add_relationships(self, rows: DataFrame) -> KG:
        """Upsert by id; rows with an unknown endpoint are dropped."""
        merged = latest(_after(self.relationships, rows), ["id"], ["ord"])
        return replace(self, relationships=with_endpoints(merged, self.nodes), unique=False)

    def remove_entities(self, ids: list[str]) -> KG:
        """Remove entities and every relationship that touches them."""
        gone = lambda c: F.col(c).isin(ids)
        return replace(
            self, entities=self.nodes.where(~gone("id")),
            relationships=self.rels.where(~gone("source_entity") & ~gone("target_entity")), unique=True,
        )

    def remove_relationships(self, ids: list[str]) -> KG:
        return replace(self, entities=self.nodes, relationships=self.rels.where(~F.col("id").isin(ids)), unique=True)

    def merge_entities(self, ids: list[str], new: DataFrame) -> KG:
        """Replace entities ``ids`` by the one row ``new`` (a bounded list given by the caller).

        Relationships are re-pointed under fresh ids (``<id>_merged``); those between two
        merged entities become self-loops; self-loops of merged entities vanish.
        """
        given = new.select("id").limit(2).collect()
        if len(given) != 1:
            raise ValueError("merging takes exactly one new entity")
        hit = lambda c: F.coalesce(F.col(c).isin(ids), F.lit(False))
        touched = hit("source_entity") | hit("target_entity")
        moved = self.rels.where(touched & (F.col("source_entity") != F.col("target_entity")))
        point: list[Column] = [F.when(hit(c), F.lit(given[0]["id"])).otherwise(F.col(c)).alias(c) for c in ("source_entity", "target_entity")]
        others = [c for c in self.rels.columns if c not in ("id", "source_entity", "target_entity")]
        moved = moved.select(F.concat("id", F.lit("_merged")).alias("id"), *point, *others).select(*self.rels.columns)
        return replace(
            self, entities=self.nodes.where(~hit("id")).unionByName(new.select(*self.nodes.columns)),
            relationships=self.rels.where(~touched).unionByName(moved), unique=False,
        )


def _after(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables with the new rows last in ``ord``."""
    last = old.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("__last"))
    shifted = new.crossJoin(F.broadcast(last)).withColumn("ord", F.col("ord") + F.col("__last") + 1).drop("__last")
    return old.unionByName(shifted.select(*old.columns))


def with_endpoints(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships whose two endpoints are known."""
    ids = nodes.select("id")
    for c in ("source_entity", "target_entity"):
        rels = rels.join(ids.withColumnRenamed("id", c), c, "left_semi")
    return rels


def reverse(rels: DataFrame) -> DataFrame:
    """Relationships with swapped endpoints under fresh ids (``<id>_reversed``)."""
    swapped = {"id": F.concat("id", F.lit("_reversed")), "source_entity": F.col("target_entity"), "target_entity": F.col("source_entity")}
    return rels.select(*[swapped.get(c, F.col(c)).alias(c) for c in rels.columns])
