"""Traversal, bounded paths and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphwright.operators.graph import KG
from graphwright.plans.durable import durable


def _adjacency(kg: KG, direction: str, types: list[str] | None) -> DataFrame:
    rels = kg.rels.where(F.col("relation_type").isin(types)) if types else kg.rels
    out = rels.select(F.col("source_entity").alias("node"), F.col("target_entity").alias("to"), F.col("id").alias("rel_id"), F.lit("outgoing").alias("way"), "ord")
    into = rels.select(F.col("target_entity").alias("node"), F.col("source_entity").alias("to"), F.col("id").alias("rel_id"), F.lit("incoming").alias("way"), "ord")
    if direction == "outgoing":
        return out
    return into if direction == "incoming" else out.unionByName(into)


def traverse(
    kg: KG, start: str, max_depth: int = 2, direction: str = "both", relationship_types: list[str] | None = None, entity_types: list[str] | None = None
) -> DataFrame:
    """Entities within ``max_depth`` of ``start``: ``(node, depth, parent, rel_id, direction)``.

    Breadth-first: every entity once, at its least depth, under the parent whose
    relationship was inserted first (outgoing before incoming).  ``start`` itself is
    row 0 and exempt from the type filter; an unknown start gives no rows.
    """
    steps = _adjacency(kg, direction, relationship_types)
    if entity_types:
        allowed = kg.nodes.where(F.col("entity_type").isin(entity_types)).select(F.col("id").alias("to"))
        steps = steps.join(allowed, "to", "left_semi")
    null = F.lit(None).cast("string")
    level = kg.entity(start).select(F.col("id").alias("node"), F.lit(0).alias("depth"), null.alias("parent"), null.alias("rel_id"), null.alias("direction"))
    seen = level = durable(level, "level")
    for depth in range(1, max_depth + 1):
        order = F.struct((F.col("way") == "incoming").alias("i"), "ord", "rel_id")
        reached = level.select("node").join(steps, "node").groupBy("to").agg(F.min_by(F.struct("node", "rel_id", "way"), order).alias("p"))
        reached = reached.join(seen.select(F.col("node").alias("to")), "to", "left_anti")
        level = durable(
            reached.select(F.col("to").alias("node"), F.lit(depth).alias("depth"), F.col("p.node").alias("parent"), F.col("p.rel_id").alias("rel_id"), F.col("p.way").alias("direction")),
            "level",
        )
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def traverse_dfs(kg: KG, start: str, max_depth: int = 2, direction: str = "both", relationship_types: list[str] | None = None, entity_types: list[str] | None = None, most: int = 100_000) -> dict:
    """Parity mode: the depth-first tree with one shared visited set, which depends on the order of insertion.

    Only the bounded neighbourhood is replayed on the driver; more than ``most``
    relationships in it is an error.
    """
    ball = traverse(kg, start, max_depth, direction, relationship_types, entity_types).select("node")
    near = kg.rels.join(ball.withColumnRenamed("node", "source_entity"), "source_entity", "left_semi").join(ball.withColumnRenamed("node", "target_entity"), "target_entity", "left_semi")
    if relationship_types:
        near = near.where(F.col("relation_type").isin(relationship_types))
    rows = near.select("id", "source_entity", "target_entity", "ord").orderBy("ord").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} relationships within {max_depth} steps of {start}")
    if ball.isEmpty():
        return {}
    inside = {r["node"] for r in ball.collect()}
    visited = {start}

    def grow(node: str, depth: int) -> dict:
        children = []
        if depth < max_depth:
            options = [(r, "outgoing", r["target_entity"]) for r in rows if r["source_entity"] == node] if direction != "incoming" else []
            options += [(r, "incoming", r["source_entity"]) for r in rows if r["target_entity"] == node] if direction != "outgoing" else []
            for r, way, other in options:
                if other in visited or other not in inside:
                    continue
                visited.add(other)
                children.append({"relationship": r["id"], "direction": way, "child": grow(other, depth + 1)})
        return {"entity": node, "children": children}

    return grow(start, 0)


def neighborhood(kg: KG, entity: str) -> DataFrame:
    """Direct neighbours in both directions."""
    return traverse(kg, entity, 1, "both")


def find_paths(kg: KG, source: str, target: str, max_depth: int = 5, relationship_types: list[str] | None = None, most: int = 10, max_hops: int | None = None) -> DataFrame:
    """The first ``most`` simple paths by length, then order of insertion: ``(path_id, hops, nodes, rel_ids)``.

    ``max_depth`` allows 2 * max_depth - 1 hops, as the original depth test does;
    ``max_hops`` sets the bound itself.  Paths that reach the target are not extended.
    """
    bound = 2 * max_depth - 1 if max_hops is None else max_hops
    first = kg.entity(source).select(F.col("id").alias("origin"))
    steps = _adjacency(kg, "outgoing", relationship_types).select(F.col("node").alias("end"), "to", "rel_id", "ord")
    level = first.select("origin", F.col("origin").alias("end"), F.array("origin").alias("nodes"), F.array().cast("array<string>").alias("rel_ids"), F.array().cast("array<bigint>").alias("ords"))
    level, found, left = durable(level, "paths"), [], most
    hits = level.where(F.col("end") == target)
    hops = 0
    while True:
        hits = hits.orderBy("ords").limit(left) if left else hits.limit(0)
        here = durable(hits, "found")
        n = here.count()
        if n:
            found.append(here)
            left -= n
        if not left or hops >= bound:
            break
        hops += 1
        open_ = level.where(F.col("end") != target)
        level = open_.join(steps, "end").where(~F.array_contains("nodes", F.col("to"))).select(
            "origin", F.col("to").alias("end"), F.array_append("nodes", F.col("to")).alias("nodes"),
            F.array_append("rel_ids", F.col("rel_id")).alias("rel_ids"), F.array_append("ords", F.col("ord")).alias("ords"),
        )
        level = durable(level, "paths")
        if level.isEmpty():
            break
        hits = level.where(F.col("end") == target)
    out = found[0] if found else level.limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    order = F.struct(F.size("rel_ids").alias("hops"), "ords")
    # At most ``most`` rows: numbering them needs no distribution.
    return out.withColumn("path_id", F.row_number().over(Window.orderBy(order))).select("path_id", F.size("rel_ids").alias("hops"), "nodes", "rel_ids")


def path_steps(kg: KG, paths: DataFrame) -> DataFrame:
    """Paths as rows ``(path_id, step, node, rel_id, relation_type, confidence)``; ``rel_id`` leads into ``node``."""
    rows = paths.select("path_id", F.posexplode("nodes").alias("step", "node"), "rel_ids")
    rows = rows.select("path_id", "step", "node", F.when(F.col("step") > 0, F.try_element_at("rel_ids", F.col("step"))).alias("rel_id"))
    facts = kg.rels.select(F.col("id").alias("rel_id"), "relation_type", "confidence")
    return rows.join(facts, "rel_id", "left").select("path_id", "step", "node", "rel_id", "relation_type", "confidence")


def find_cycles(edges: DataFrame, longest: int, kind: str = "kind") -> DataFrame:
    """Elementary cycles of 2 to ``longest`` edges of one kind: ``(kind, start, nodes, length)``, each from its least node."""
    step = edges.where("s <> t").select(kind, F.col("s").alias("end"), F.col("t").alias("to"))
    level = step.where(F.col("to") > F.col("end")).select(kind, F.col("end").alias("start"), F.col("to").alias("end"), F.array("end", "to").alias("nodes"))
    found = None
    for length in range(2, longest + 1):
        onward = level.join(step, [kind, "end"])
        closed = onward.where(F.col("to") == F.col("start")).select(kind, "start", "nodes", F.lit(length).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        level = onward.where((F.col("to") > F.col("start")) & ~F.array_contains("nodes", F.col("to"))).select(kind, "start", F.col("to").alias("end"), F.array_append("nodes", F.col("to")).alias("nodes"))
    return found


def strong_components(edges: DataFrame, kind: str = "kind") -> DataFrame:
    """``(kind, node, component)`` of all nodes that lie on a cycle of two or more edges of one kind, of any length.

    ``component`` is one of the component's nodes.  Nodes without a way in or out are
    trimmed; then every node takes the least node that reaches it, and what leads back to that
    node inside its colour is one component.  Rounds go on until no edge is left.
    """
    open_ = durable(edges.where("s <> t").select(kind, "s", "t").distinct(), "open")
    found = open_.select(kind, F.col("s").alias("node"), F.col("s").alias("component")).limit(0)
    while True:
        size = open_.count()
        while size:
            into, out = open_.select(kind, F.col("t").alias("s")).distinct(), open_.select(kind, F.col("s").alias("t")).distinct()
            kept = durable(open_.join(into, [kind, "s"], "left_semi").join(out, [kind, "t"], "left_semi").select(kind, "s", "t"), "open", replaces=open_)
            open_, before, size = kept, size, kept.count()
            if size == before:
                break
        if not size:
            return found
        nodes = open_.select(kind, F.col("s").alias("node")).unionByName(open_.select(kind, F.col("t").alias("node"))).distinct()
        colour = durable(nodes.withColumn("least", F.col("node")), "colour")
        moved = colour
        while not moved.isEmpty():
            sent = open_.join(moved.withColumnRenamed("node", "s"), [kind, "s"]).groupBy(kind, F.col("t").alias("node")).agg(F.min("least").alias("new"))
            both = durable(colour.join(sent, [kind, "node"], "left").select(kind, "node", F.least("least", "new").alias("least"), (F.col("new") < F.col("least")).alias("moved")), "colour", replaces=colour)
            colour, moved = both.drop("moved"), both.where("moved").drop("moved")
            colour._durable_path = both._durable_path
        inside = open_.join(colour.withColumnsRenamed({"node": "s", "least": "cs"}), [kind, "s"]).join(colour.withColumnsRenamed({"node": "t", "least": "ct"}), [kind, "t"])
        inside = durable(inside.where("cs = ct").select(kind, "s", "t", F.col("cs").alias("c")), "inside", replaces=open_)
        level = durable(colour.where("node = least").select(kind, "node", F.col("node").alias("component")), "back")
        back = level
        while not level.isEmpty():
            # Against the edges, inside the colour of the component's node.
            onward = inside.join(level.withColumnsRenamed({"node": "t", "component": "c"}), [kind, "t", "c"]).select(kind, F.col("s").alias("node"), F.col("c").alias("component")).distinct()
            level = durable(onward.join(back, [kind, "node", "component"], "left_anti"), "back")
            back = back.unionByName(level)
        back = durable(back, "component")
        real = back.join(back.groupBy(kind, "component").count().where("count > 1").select(kind, "component"), [kind, "component"], "left_semi")
        found = found.unionByName(real.select(kind, "node", "component"))
        gone = back.select(kind, F.col("node").alias("s"))
        left = inside.join(gone, [kind, "s"], "left_anti").join(gone.withColumnRenamed("s", "t"), [kind, "t"], "left_anti")
        open_ = durable(left.select(kind, "s", "t"), "open", replaces=inside)


def cycle_witnesses(edges: DataFrame, kind: str = "kind") -> DataFrame:
    """``(kind, start, nodes, length, members)``: for each component of :func:`strong_components` one shortest cycle through its least node.

    Of several shortest cycles the one of the least nodes in order is given; ``members`` counts the component's nodes.
    The search keeps one path a node, so its work is bounded by the component's edges.
    """
    parts = durable(strong_components(edges, kind), "components")
    heads = durable(parts.groupBy(kind, "component").agg(F.min("node").alias("start"), F.count(F.lit(1)).alias("members")), "heads")
    step = edges.where("s <> t").select(kind, F.col("s").alias("end"), F.col("t").alias("to")).distinct()
    step = step.join(parts.select(kind, F.col("node").alias("end"), "component"), [kind, "end"]).join(parts.select(kind, F.col("node").alias("to"), F.col("component").alias("there")), [kind, "to"])
    step = durable(step.where("component = there").select(kind, "component", "end", "to"), "steps")
    level = durable(heads.select(kind, "component", "start", F.col("start").alias("end"), F.array("start").alias("nodes")), "level")
    seen, found, length = level.select(kind, "component", "end"), None, 0
    while not level.isEmpty():
        length += 1
        onward = durable(level.join(step, [kind, "component", "end"]), "onward")
        closed = onward.where(F.col("to") == F.col("start")).groupBy(kind, "component", "start").agg(F.min("nodes").alias("nodes")).withColumn("length", F.lit(length))
        closed = durable(closed, "closed")
        found = closed if found is None else found.unionByName(closed)
        rest = onward.join(closed, [kind, "component"], "left_anti").groupBy(kind, "component", "start", F.col("to").alias("end")).agg(F.min(F.array_append("nodes", F.col("to"))).alias("nodes"))
        level = durable(rest.join(seen, [kind, "component", "end"], "left_anti").select(kind, "component", "start", "end", "nodes"), "level")
        seen = seen.unionByName(level.select(kind, "component", "end"))
    if found is None:
        return heads.select(kind, "start", F.array("start").alias("nodes"), F.lit(0).alias("length"), "members").limit(0)
    return found.join(heads.select(kind, "component", "members"), [kind, "component"]).select(kind, "start", "nodes", "length", "members")


def all_cycles(edges: DataFrame, longest: int, kind: str = "kind") -> DataFrame:
    """:func:`find_cycles`, and the witness of every component that has no cycle so short: ``(kind, start, nodes, length)``.

    So every cyclic component is reported, whatever the length of its cycles; only the
    enumeration of all cycles of a component, of which there can be exponentially many, is bounded.
    """
    edges = durable(edges, "edges")
    parts = durable(strong_components(edges, kind), "components")
    # A cycle lies inside one component: what leads from one to another, or through a hub without a way back, closes none.
    ends = parts.select(kind, F.col("node").alias("s"), F.col("component").alias("cs")), parts.select(kind, F.col("node").alias("t"), F.col("component").alias("ct"))
    edges = durable(edges.join(ends[0], [kind, "s"]).join(ends[1], [kind, "t"]).where("cs = ct").select(kind, "s", "t"), "inside")
    short = durable(find_cycles(edges, longest, kind), "short")
    told = short.join(parts.withColumnRenamed("node", "start"), [kind, "start"]).select(kind, "component").distinct()
    silent = parts.join(told, [kind, "component"], "left_anti").select(kind, F.col("node").alias("s"))
    rest = edges.join(silent, [kind, "s"], "left_semi").join(silent.withColumnRenamed("s", "t"), [kind, "t"], "left_semi")
    return short.unionByName(cycle_witnesses(rest.select(kind, "s", "t"), kind).drop("members"))
