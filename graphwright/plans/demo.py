"""A small sample graph and its pages: ``python -m graphwright.plans.demo FOLDER``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from graphwright.operators import viz
from graphwright.operators.graph import KG
from graphwright.schema import entity_frame, relationship_frame

_PEOPLE = [("ann", "Ann"), ("ben", "Ben"), ("cleo", "Cleo")]
_PLACES = [("lab", "Harbour Lab", "Organization"), ("city", "Westport", "Location"), ("maps", "Tide Maps", "Project"), ("gis", "Cartography", "Skill")]


def sample_graph(spark: SparkSession) -> KG:
    """Three people, where they work, what they can do and what they build."""
    nodes = [{"id": i, "name": n, "type": "Person", "confidence": 0.9 - k / 10} for k, (i, n) in enumerate(_PEOPLE)]
    nodes += [{"id": i, "name": n, "type": t, "confidence": 0.85} for i, n, t in _PLACES]
    rels = [{"source": i, "target": "lab", "type": "works-for", "confidence": 0.9} for i, _ in _PEOPLE]
    rels += [{"source": "ann", "target": "gis", "type": "has-skill", "confidence": 0.9}, {"source": "gis", "target": "maps", "type": "required-for", "confidence": 0.9}]
    rels += [{"source": "lab", "target": "city", "type": "located-in"}, {"source": "ann", "target": "ben", "type": "knows", "bidirectional": True, "confidence": 0.7}]
    return KG(entity_frame(spark, nodes), relationship_frame(spark, rels), name="sample")


def main(folder: str) -> None:
    spark = SparkSession.builder.appName("demo").getOrCreate()
    kg = sample_graph(spark)
    pages = {"graph": viz.to_html(kg), "subgraph": viz.subgraph_html(kg, ["ann"]), "path": viz.path_html(kg, "ann", "maps"), "filtered": viz.filtered_html(kg, ["Person", "Organization"])}
    spark.createDataFrame(list(pages.items()), "name string, page string").write.mode("overwrite").partitionBy("name").text(folder)


if __name__ == "__main__":
    main(sys.argv[1])
