"""Summaries of segments with a cache that is joined, not looked up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.text import strip
from graphwright.operators.provider import Provider, RuleProvider
from graphwright.plans.durable import durable

LEAST_CHARS = 10
CACHE = "key string, summary string, key_points array<string>, role string, keywords array<string>"


def cache_key(text: Column, segment_type: Column, language: Column) -> Column:
    """MD5 of text, type and language."""
    return F.md5(F.concat_ws("|", text, segment_type, language))


def summarize(segments: DataFrame, cache: DataFrame | None = None, provider: Callable[[], Provider] = RuleProvider, language: str = "en") -> tuple[DataFrame, DataFrame]:
    """(summaries, cache): summaries of segments with at least ten characters.

    Equal texts are summarised once; the segment's id is stamped after the join with
    the cache, so a cached record never carries another segment's id.
    """
    asked = segments.where(F.length(strip(F.col("text"))) >= LEAST_CHARS).withColumn("language", F.lit(language))
    asked = asked.withColumn("key", cache_key(F.col("text"), F.col("segment_type"), F.col("language")))
    wanted = asked.groupBy("key").agg(F.first("text").alias("text"))
    missing = wanted.join(cache.select("key"), "key", "left_anti") if cache is not None else wanted

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for batch in batches:
            out = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                s = model.generate_json(text, {"task": "summary"})
                out.append((key, s.get("summary", ""), list(s.get("key_points", [])), s.get("role", ""), list(s.get("keywords", []))))
            yield pd.DataFrame(out, columns=["key", "summary", "key_points", "role", "keywords"])

    new = durable(missing.select("key", "text").mapInPandas(run, CACHE), "summaries")
    full = new if cache is None else cache.select(*new.columns).unionByName(new)
    rows = asked.join(full, "key").select(F.col("id").alias("segment_id"), "segment_type", "language", "summary", "key_points", "role", "keywords")
    return rows, full
