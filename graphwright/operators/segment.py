"""Segmentation of texts, segment trees and their navigation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.functions.text import normalize_text, pack_paragraphs, strip
from graphwright.operators.provider import Provider
from graphwright.plans.durable import durable
from graphwright.schema import SEGMENTS, json_text

#: Paragraphs longer than this are split into sentences.
LONG_PARAGRAPH = 200
_SENTENCE = r"(?U)(?<=[.!?])\s+"


def rule_segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long_paragraph: int = LONG_PARAGRAPH) -> DataFrame:
    """Segments by rule: document, paragraphs, sentences of long paragraphs (``graphwright.schema.SEGMENTS``).

    Ids are paths (``d``, ``d.p``, ``d.p.s``); blank paragraphs are skipped and not
    numbered; ``start`` and ``end`` are character offsets in the document.
    """
    base = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("row", F.monotonically_increasing_id())
    parts = _pieces(base, ["doc_id", "row"], F.col("body"), r"\n(?U:\s)*\n")
    lead = F.length("part") - F.length(F.regexp_replace("part", r"(?U)^\s+", ""))
    paras = parts.select("doc_id", "row", "place", strip(F.col("part")).alias("text"), (F.col("at") + lead).alias("start")).where("text <> ''")
    paras = paras.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "row")) - 1).select("doc_id", "i", "text", "start")
    paras = paras.withColumn("sentences", F.when(F.length("text") > long_paragraph, F.split("text", _SENTENCE)).otherwise(F.array().cast("array<string>")))
    paras = paras.withColumn("sentences", F.filter("sentences", lambda x: x != ""))
    pid = F.concat("doc_id", F.lit("."), F.col("i") + 1)
    empty = F.array().cast("array<string>")
    children = F.transform(F.col("sentences"), lambda _, k: F.concat(pid, F.lit("."), k + 1))
    para_rows = paras.select(
        "doc_id", pid.alias("id"), F.col("doc_id").alias("parent_id"), F.lit(1).alias("level"), (F.col("i") + 1).cast("bigint").alias("ord"), F.lit("paragraph").alias("segment_type"),
        F.lit(None).cast("string").alias("title"), "text", "start", (F.col("start") + F.length("text")).alias("end"), children.alias("children_ids"),
    )
    long_ = paras.where(F.size("sentences") > 0).select("doc_id", pid.alias("parent_id"), "start", "text")
    cut = _pieces(long_, ["doc_id", "parent_id", "start"], F.col("text"), _SENTENCE).where("part <> ''")
    k = F.row_number().over(Window.partitionBy("doc_id", "parent_id").orderBy("place"))
    sentence_rows = cut.withColumn("k", k).select(
        "doc_id", F.concat("parent_id", F.lit("."), "k").alias("id"), "parent_id", F.lit(2).alias("level"), F.col("k").cast("bigint").alias("ord"), F.lit("sentence").alias("segment_type"),
        F.lit(None).cast("string").alias("title"), F.col("part").alias("text"), (F.col("start") + F.col("at")).alias("start"), (F.col("start") + F.col("at") + F.length("part")).alias("end"), empty.alias("children_ids"),
    )
    counts = paras.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    kids = F.when(F.col("n").isNull(), empty).otherwise(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat("doc_id", F.lit("."), k)))
    root = base.join(counts, "doc_id", "left").select(
        "doc_id", F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("ord"), F.lit("document").alias("segment_type"),
        F.lit(None).cast("string").alias("title"), F.col("body").alias("text"), F.lit(0).alias("start"), F.length("body").alias("end"), kids.alias("children_ids"),
    )
    return root.unionByName(para_rows).unionByName(sentence_rows)


def _pieces(rows: DataFrame, keep: list[str], text: Column, between: str) -> DataFrame:
    """``(*keep, place, part, at)``: what lies between the matches of ``between``, with the offset at which each part starts.

    Parts and gaps are cut by the same pattern, so their lengths add up; ``keep`` names the text.
    """
    zipped = F.arrays_zip(F.split(text, between).alias("part"), F.regexp_extract_all(text, F.lit(f"({between})"), F.lit(1)).alias("gap"))
    out = rows.select(*keep, F.posexplode(zipped).alias("place", "z"))
    before = Window.partitionBy(*keep).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.length("z.part") + F.coalesce(F.length("z.gap"), F.lit(0))
    return out.select(*keep, "place", F.col("z.part").alias("part"), F.coalesce(F.sum(spent).over(before), F.lit(0)).cast("int").alias("at"))


def packed_segments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 1000) -> DataFrame:
    """Paragraphs packed greedily: ``(doc_id, id, text, position, length)``."""
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.explode(pack_paragraphs(F.col(text), most)).alias("s"))
    return rows.select("doc_id", "s.id", "s.text", "s.position", "s.length")


def children(segments: DataFrame, id_: str) -> DataFrame:
    """Children in the parent's order; listed ids without a segment are skipped."""
    listed = segments.where(F.col("id") == id_).select(F.posexplode("children_ids").alias("place", "id"))
    return listed.join(segments, "id").orderBy("place").drop("place")


def parent(segments: DataFrame, id_: str) -> DataFrame:
    own = segments.where(F.col("id") == id_).select(F.col("parent_id").alias("id"))
    return segments.join(own, "id", "left_semi")


def hierarchical_id(metadata: Column, id_: Column) -> Column:
    """``hierarchical_id`` of the metadata, or the id."""
    return F.coalesce(F.element_at(metadata, "hierarchical_id"), id_)


def hierarchy(segments: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(id, depth, path)``: depth and slash-joined path from the root of every segment, of any depth (or up to ``max_depth``).

    A segment whose parents form a ring has no root and no row.
    """
    level = durable(segments.where("parent_id is null").select("id", F.lit(0).alias("depth"), F.col("id").alias("path")), "level")
    out = level
    links = segments.where("parent_id is not null").select(F.col("id").alias("child"), "parent_id")
    depth = 0
    while not level.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        below = level.join(links, level["id"] == links["parent_id"])
        level = durable(below.select(F.col("child").alias("id"), F.lit(depth).alias("depth"), F.concat("path", F.lit("/"), "child").alias("path")), "level")
        out = out.unionByName(level)
    return out


def tree_json(segments: DataFrame, doc_id: str) -> str:
    """Nested JSON of one document's segments (bounded by that document)."""
    rows = [r.asDict(recursive=True) for r in segments.where(F.col("doc_id") == doc_id).orderBy("level", "ord").collect()]
    nodes = {r["id"]: {**r, "children": []} for r in rows}
    roots = []
    for r in rows:
        (nodes[r["parent_id"]]["children"] if r["parent_id"] in nodes else roots).append(nodes[r["id"]])
    return json_text(roots)


def flatten_answer(doc: str, answer: str) -> list[tuple]:
    """Rows of ``graphwright.schema.SEGMENTS`` out of one nested answer; none if it is malformed."""
    out: list[tuple] = []

    def flatten(node: dict[str, Any], parent_id: str | None, path: str, level: int, place: int) -> str:
        kids = node.get("segments") or node.get("children") or []
        spot = node.get("position") or {}
        ids = [flatten(k, path, f"{path}.{i + 1}", level + 1, i + 1) for i, k in enumerate(kids) if isinstance(k, dict)]
        out.append((doc, path, parent_id, level, place, node.get("type") or node.get("segment_type") or "segment", node.get("title"), node.get("text") or "", spot.get("start"), spot.get("end"), ids))
        return path

    try:
        node = json.loads(answer[answer.find("{") : answer.rfind("}") + 1])
    except ValueError:
        return out
    for i, top in enumerate(node.get("segments", [node])):
        flatten(top, None, f"{doc}.{i + 1}", 0, i + 1)
    return out


def parse_segments(spark: SparkSession, answers: list[tuple[str, str]]) -> DataFrame:
    """Segments out of nested model answers ``(doc_id, json)``."""
    return spark.createDataFrame([row for doc, answer in answers for row in flatten_answer(doc, answer)], SEGMENTS)


def model_segments(docs: DataFrame, provider: Callable[[], Provider], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments by a model's nested answer, one call per document, one provider per partition.

    An answer is ``{"segments": [{"type", "title", "text", "position", "segments"}]}``; ids
    are paths, levels start at 0; documents with a malformed answer give no rows.
    """
    columns = [c.split()[0] for c in SEGMENTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for batch in batches:
            out: list[tuple] = []
            for doc, body in zip(batch["doc_id"], batch["text"], strict=True):
                out += flatten_answer(doc, json.dumps(model.generate_json(body or "", {"task": "segments"})))
            yield pd.DataFrame(out, columns=columns).astype({"start": "Int32", "end": "Int32"})

    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, SEGMENTS)


def segment_text(docs: DataFrame, provider: Callable[[], Provider] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments by the given provider, or by rule."""
    return model_segments(docs, provider, doc_id, text) if provider else rule_segments(docs, doc_id, text)


def normalized(segments: DataFrame) -> DataFrame:
    """Segments with normalised texts: segment first, because normalising a whole text removes its line ends."""
    return segments.withColumn("text", normalize_text(F.col("text")))
