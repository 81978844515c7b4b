"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphwright.llm import langid, media, neardup_vectors, packing, secrets, segments, sharding, simhash, toolcalls, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.features(_table(spark, sf_dir, "documents")))


def op2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segmentation_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages hold no link to another host, so the host graph is that of the names (``parents``)."""
    return urlfilter.judge(_table(spark, sf_dir, "pages"), parents=True)


def op9_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link_calls(*toolcalls.read_calls(_table(spark, sf_dir, "conversations")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media,
        "op2_segments": op2_segments,
        "op3_packing": op3_packing,
        "op4_lattice": op4_lattice,
        "op5_language": op5_language,
        "op6_simhash": op6_simhash,
        "op7_sharding": op7_sharding,
        "op8_urls": op8_urls,
        "op9_toolcalls": op9_toolcalls,
        "op10_secrets": op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the operator; the others hash, learn or search, and tests hold them against brute force."""
    return {"op8_urls": urlfilter.oracle_sql(parents=True), "op9_toolcalls": toolcalls.oracle_sql()}
