"""Visual styles as rows, and a self-contained HTML page of a bounded graph."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.operators.graph import KG, with_endpoints
from graphwright.operators.query import subgraph
from graphwright.operators.traverse import find_paths
from graphwright.schema import plain_text

#: Colours by scheme. Fixed values.
ENTITY_COLORS = {
    "default": {"Person": "#4682B4", "Organization": "#D2691E", "Location": "#228B22", "Event": "#8A2BE2", "Concept": "#FF8C00", "Skill": "#20B2AA", "Job": "#CD5C5C", "Project": "#9370DB", "default": "#A9A9A9"},
    "grayscale": {"default": "#555555"},
    "pastel": {"Person": "#FFB6C1", "Organization": "#FFD700", "Location": "#98FB98", "Event": "#DDA0DD", "Concept": "#FFDAB9", "Skill": "#AFEEEE", "Job": "#FFA07A", "Project": "#D8BFD8", "default": "#E6E6FA"},
}
RELATION_COLORS = {
    "default": {"is-a": "#0000CD", "part-of": "#2E8B57", "has": "#8B4513", "related-to": "#4B0082", "causes": "#B22222", "works-for": "#1E90FF", "knows": "#9932CC", "has-skill": "#228B22", "default": "#696969"},
    "grayscale": {"default": "#999999"},
    "pastel": {"default": "#B0C4DE"},
}
#: Rows that a page may hold.
PAGE_ROWS = 5000


def _color(key: Column, table: dict[str, str]) -> Column:
    named = [F.lit(x) for k, v in table.items() if k != "default" for x in (k, v)]
    return F.coalesce(F.element_at(F.create_map(*named), key), F.lit(table["default"])) if named else F.lit(table["default"])


def _two(x: Column) -> Column:
    return F.format_string("%.2f", x)


def node_styles(kg: KG, scheme: str = "default") -> DataFrame:
    """``(id, label, color, shape, size)``: name, type, the first three attributes by name, and confidence as the label."""
    keys = F.slice(F.array_sort(F.map_keys("attributes")), 1, 3)
    lines = F.transform(keys, lambda k: F.concat(k, F.lit(": "), plain_text(F.element_at("attributes", k))))
    label = F.concat(
        "name", F.lit("<br><i>"), "entity_type", F.lit("</i>"), F.when(F.size(lines) > 0, F.concat(F.lit("<br>"), F.array_join(lines, "<br>"))).otherwise(""),
        F.lit("<br>confidence: "), _two(F.col("confidence")),
    )
    color = _color(F.col("entity_type"), ENTITY_COLORS.get(scheme, ENTITY_COLORS["default"]))
    return kg.nodes.select(
        "id", label.alias("label"), color.alias("color"), F.when(F.col("entity_type") == "Person", "dot").otherwise("box").alias("shape"),
        F.when(F.col("confidence") > 0.8, 30).otherwise(20).alias("size"),
    )


def edge_styles(kg: KG, scheme: str = "default") -> DataFrame:
    """``(source, target, label, title, color, width)``; bidirectional relationships in both directions."""
    color = _color(F.lower("relation_type"), RELATION_COLORS.get(scheme, RELATION_COLORS["default"]))
    title = F.concat("relation_type", F.lit(" (confidence: "), _two(F.col("confidence")), F.lit(")"))
    rows = kg.rels.select(
        F.col("source_entity").alias("source"), F.col("target_entity").alias("target"), F.col("relation_type").alias("label"), title.alias("title"),
        color.alias("color"), (1.0 + 4.0 * F.col("confidence")).alias("width"), "bidirectional",
    )
    back = rows.where("bidirectional").withColumns({"source": F.col("target"), "target": F.col("source")})
    return rows.unionByName(back).drop("bidirectional")


def filtered(kg: KG, entity_types: list[str] | None = None, relationship_types: list[str] | None = None, least: float = 0.0) -> KG:
    """The graph of the chosen types and confidence; relationships need both endpoints."""
    nodes = kg.nodes.where(F.col("confidence") >= least)
    rels = kg.rels.where(F.col("confidence") >= least)
    if entity_types:
        nodes = nodes.where(F.col("entity_type").isin(entity_types))
    if relationship_types:
        rels = rels.where(F.col("relation_type").isin(relationship_types))
    return KG(nodes, with_endpoints(rels, nodes), name=f"filtered_{kg.name}", unique=True)


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>%(title)s</title><style>body{margin:0;font:12px sans-serif}svg{width:100vw;height:100vh}</style></head>
<body><svg id="g"></svg><script>
const nodes=%(nodes)s, edges=%(edges)s, ns="http://www.w3.org/2000/svg", svg=document.getElementById("g"), at={};
const r=Math.max(200,nodes.length*12), draw=(tag,set,text)=>{const e=document.createElementNS(ns,tag);for(const k in set)e.setAttribute(k,set[k]);if(text){const t=document.createElementNS(ns,"title");t.textContent=text;e.appendChild(t)}svg.appendChild(e);return e};
svg.setAttribute("viewBox",[-r*1.2,-r*1.2,r*2.4,r*2.4].join(" "));
nodes.forEach((n,i)=>{const a=2*Math.PI*i/nodes.length;at[n.id]=[r*Math.cos(a),r*Math.sin(a)]});
edges.forEach(e=>{const p=at[e.source],q=at[e.target];if(p&&q)draw("line",{x1:p[0],y1:p[1],x2:q[0],y2:q[1],stroke:e.color,"stroke-width":e.width},e.title)});
nodes.forEach(n=>{const p=at[n.id];draw(n.shape=="dot"?"circle":"rect",n.shape=="dot"?{cx:p[0],cy:p[1],r:n.size/2,fill:n.color}:{x:p[0]-n.size/2,y:p[1]-n.size/2,width:n.size,height:n.size,fill:n.color},n.label);draw("text",{x:p[0]+n.size/2,y:p[1]}).textContent=n.label.split("<br>")[0]});
</script></body></html>"""


def to_html(kg: KG, scheme: str = "default", most: int = PAGE_ROWS) -> str:
    """A page of at most ``most`` entities and as many relationships; a larger graph is an error, not cut."""
    nodes, edges = node_styles(kg, scheme).limit(most + 1).collect(), edge_styles(kg, scheme).limit(most + 1).collect()
    if max(len(nodes), len(edges)) > most:
        raise ValueError(f"a page holds {most} rows; choose a subgraph or filter first")
    data = lambda rows: json.dumps([r.asDict() for r in rows], ensure_ascii=False).replace("</", "<\\/")
    return _PAGE % {"title": html.escape(kg.name), "nodes": data(nodes), "edges": data(edges)}


def save_html(kg: KG, path: str, scheme: str = "default") -> str:
    """Write the page through the cluster's file system; returns the path."""
    spark = kg.entities.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(conf).create(target, True)
    try:
        stream.write(bytearray(to_html(kg, scheme).encode()))
    finally:
        stream.close()
    return path


def subgraph_html(kg: KG, ids: list[str], scheme: str = "default") -> str:
    """Page of some entities and their neighbours."""
    return to_html(subgraph(kg, ids, include_neighbors=True), scheme)


def path_html(kg: KG, source: str, target: str, max_depth: int = 5, scheme: str = "default") -> str:
    """Page of the first path between two entities."""
    first = find_paths(kg, source, target, max_depth, most=1).first()
    ids = list(first["nodes"]) if first else []
    return to_html(subgraph(kg, ids), scheme)


def filtered_html(kg: KG, entity_types: list[str] | None = None, relationship_types: list[str] | None = None, least: float = 0.6) -> str:
    """Page of the filtered graph."""
    return to_html(filtered(kg, entity_types, relationship_types, least))
