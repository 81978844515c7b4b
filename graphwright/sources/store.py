"""Versioned graph store: parquet per version and a manifest that is only appended to."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.operators.graph import KG
from graphwright.schema import ENTITIES, RELATIONSHIPS

MANIFEST = "graph string, version_id string, created_at timestamp, entity_count bigint, relationship_count bigint, description string, event string, seq bigint"


def sanitize_name(name: str) -> str:
    """A name that is safe as a folder: blanks and slashes become underscores."""
    return name.replace(" ", "_").replace("/", "_").replace("\\", "_")


class GraphStore:
    """Graphs below ``root``: ``<name>/<version>/{entities,relationships}`` and ``manifest``.

    A save writes a new version and then one manifest row, so readers see whole
    versions or none; the newest version is the current graph.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(conf), target

    def manifest(self) -> DataFrame:
        fs, target = self._fs(f"{self.root}/manifest")
        if not fs.exists(target):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")

    def _append(self, graph: str, version: str, entities: int | None, rels: int | None, description: str | None, event: str) -> None:
        row = [(graph, version, entities, rels, description, event, time.time_ns())]
        kind = "graph string, version_id string, entity_count bigint, relationship_count bigint, description string, event string, seq bigint"
        rows = self.spark.createDataFrame(row, kind).withColumn("created_at", F.timestamp_micros((F.col("seq") / 1000).cast("bigint")))
        rows.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def save(self, kg: KG, name: str | None = None, description: str | None = None) -> str:
        """Write a new version; returns its id."""
        graph = sanitize_name(name or kg.name)
        version = f"{graph}_{time.time_ns()}_{uuid.uuid4().hex[:6]}"
        base = f"{self.root}/{graph}/{version}"
        kg.nodes.write.parquet(f"{base}/entities")
        kg.rels.write.parquet(f"{base}/relationships")
        counts = [self.spark.read.parquet(f"{base}/{t}").count() for t in ("entities", "relationships")]
        self._append(graph, version, *counts, description, "save")
        return version

    def _alive(self) -> DataFrame:
        """Manifest rows of versions that were not deleted, with the latest description."""
        rows = self.manifest()
        versions = rows.groupBy("graph", "version_id").agg(
            F.min("created_at").alias("created_at"), F.min("seq").alias("seq"), F.max("entity_count").alias("entity_count"), F.max("relationship_count").alias("relationship_count"),
            F.max_by("description", F.when(F.col("description").isNotNull(), F.col("seq"))).alias("description"), F.max((F.col("event") == "delete").cast("int")).alias("gone"),
        )
        return versions.where("gone = 0").drop("gone")

    def list_graphs(self) -> DataFrame:
        """``(graph, versions, entity_count, relationship_count, created_at, updated_at)`` of every graph."""
        return self._alive().groupBy("graph").agg(
            F.count(F.lit(1)).alias("versions"), F.max_by("entity_count", "seq").alias("entity_count"), F.max_by("relationship_count", "seq").alias("relationship_count"),
            F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"),
        )

    def list_versions(self, name: str) -> DataFrame:
        """Versions of a graph, newest first."""
        return self._alive().where(F.col("graph") == sanitize_name(name)).orderBy(F.desc("seq"))

    def load(self, name: str, version: str | None = None) -> KG:
        """The newest or the given version; a missing one is an error."""
        graph = sanitize_name(name)
        found = self.list_versions(name)
        row = (found.where(F.col("version_id") == version) if version else found).first()
        if row is None:
            raise FileNotFoundError(f"no graph {name!r}" + (f" in version {version!r}" if version else ""))
        base = f"{self.root}/{graph}/{row['version_id']}"
        return KG(self.spark.read.schema(ENTITIES).parquet(f"{base}/entities"), self.spark.read.schema(RELATIONSHIPS).parquet(f"{base}/relationships"), name=name, unique=True)

    def delete(self, name: str, versions: bool = True) -> bool:
        """Delete a graph: all versions, or the newest only. False if there is none."""
        found = [r["version_id"] for r in self.list_versions(name).collect()]
        for version in found if versions else found[:1]:
            fs, target = self._fs(f"{self.root}/{sanitize_name(name)}/{version}")
            self._append(sanitize_name(name), version, None, None, None, "delete")
            fs.delete(target, True)
        return bool(found)

    def describe(self, name: str, version: str, description: str) -> None:
        """Attach a text to a version; an unknown one is an error."""
        if self.list_versions(name).where(F.col("version_id") == version).isEmpty():
            raise KeyError(version)
        self._append(sanitize_name(name), version, None, None, description, "describe")


def save_graph(spark: SparkSession, root: str, kg: KG, name: str | None = None) -> str:
    return GraphStore(spark, root).save(kg, name)


def load_graph(spark: SparkSession, root: str, name: str, version: str | None = None) -> KG:
    return GraphStore(spark, root).load(name, version)
