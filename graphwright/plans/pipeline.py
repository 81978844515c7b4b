"""End to end: texts to segments, summaries and a verified graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.functions.language import detect_language
from graphwright.operators import coref, extract, metrics, segment, summarize, verify
from graphwright.operators.graph import KG
from graphwright.operators.provider import get_provider
from graphwright.plans.config import Config, Timer
from graphwright.plans.durable import durable


@dataclass(frozen=True)
class TextResult:
    documents: DataFrame
    segments: DataFrame
    summaries: DataFrame
    cache: DataFrame


@dataclass(frozen=True)
class KnowledgeResult:
    text: TextResult
    graph: KG
    groups: DataFrame
    id_map: DataFrame
    issues: DataFrame
    seconds: dict[str, float]

    def counts(self) -> DataFrame:
        """One row of counters of the run."""
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        out = n(self.text.segments, "segments").crossJoin(n(self.text.summaries, "summaries")).crossJoin(n(self.graph.nodes, "entities"))
        return out.crossJoin(n(self.graph.rels, "relationships")).crossJoin(n(self.issues, "issues"))


def process_text(docs: DataFrame, config: Config | None = None, doc_id: str = "doc_id", text: str = "text", cache: DataFrame | None = None) -> TextResult:
    """Language, segments and summaries. Segments come first, so that line ends still tell paragraphs."""
    config = config or Config()
    known = docs.withColumn("language", detect_language(F.col(text)))
    segments = durable(segment.rule_segments(docs, doc_id, text), "segments")
    make = _provider(config)
    summaries, full = summarize.summarize(segments.where("level > 0"), cache, make, config.language)
    return TextResult(known, segments, summaries, full)


def _provider(config: Config):
    name, options = config.provider, dict(config.provider_options)
    return lambda: get_provider(name, **options)


def extract_knowledge(docs: DataFrame, config: Config | None = None, doc_id: str = "doc_id", text: str = "text") -> KnowledgeResult:
    """Texts to a graph: segments, entities, relationships, coreference with re-pointed relationships, verification."""
    config, timer = config or Config(), Timer()
    with timer.measure("text"):
        texts = process_text(docs, config, doc_id, text)
    with timer.measure("extraction"):
        kg = extract.extract_graph(texts.segments.where("level = 1"), _provider(config))
    with timer.measure("coreference"):
        resolved, groups, mapping = coref.resolve(kg, config.coref_threshold)
        resolved = KG(durable(resolved.nodes, "nodes"), durable(resolved.rels, "rels"), name=kg.name, unique=True)
    with timer.measure("verification"):
        issues = durable(verify.verify(resolved.nodes, resolved.rels, config.longest_cycle), "issues")
    return KnowledgeResult(texts, resolved, groups, mapping, issues, timer.seconds)


def write_artifacts(result: KnowledgeResult, path: str) -> None:
    """Every stage's table as JSON lines below ``path``."""
    tables = {
        "segments": result.text.segments, "summaries": result.text.summaries, "entities": result.graph.nodes, "relationships": result.graph.rels,
        "coreference_groups": result.groups, "id_map": result.id_map, "issues": result.issues, "metrics": metrics.type_counts(result.graph),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")
