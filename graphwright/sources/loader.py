"""Reading texts: files with encoding detection, or literals."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions.language import detect_language, is_supported
from graphwright.functions.text import normalize_loaded

#: Bytes of a file that decide its encoding.
SAMPLE = 10_000


def _encoding(head: bytes | None) -> str:
    head = bytes(head or b"")
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
        return "utf-8"
    except UnicodeDecodeError:
        pass
    # Cyrillic in a one-byte encoding has many bytes in the range of its lower-case letters.
    high = sum(b >= 0xC0 for b in head)
    return "windows-1251" if high > 0.3 * max(1, len(head)) else "windows-1252"


def detect_encoding(content: Column) -> Column:
    """Encoding by byte order mark, strict UTF-8, then the share of high bytes."""

    @F.pandas_udf("string")
    def detect(heads: pd.Series) -> pd.Series:
        return heads.map(_encoding)

    return detect(F.substring(content, 1, SAMPLE))


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size, modified, encoding, text)`` of the files under ``path``; empty files are left out."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")

    @F.pandas_udf("string")
    def decode(contents: pd.Series, encodings: pd.Series) -> pd.Series:
        return pd.Series([bytes(c).decode(e, "replace") for c, e in zip(contents, encodings, strict=True)], dtype="object")

    found = files.withColumn("encoding", detect_encoding(F.col("content")))
    return found.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "encoding", decode("content", "encoding").alias("text")
    )


def load_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    """``(text)`` of the non-empty literals."""
    return spark.createDataFrame([(t,) for t in texts if t], "text string")


def process(texts: DataFrame, column: str = "text") -> DataFrame:
    """Adds ``normalized``, ``language``, ``supported`` and ``n_chars``."""
    done = texts.withColumn("normalized", normalize_loaded(F.col(column)))
    done = done.withColumn("language", detect_language(F.col("normalized")))
    return done.withColumns({"supported": F.coalesce(is_supported(F.col("language")), F.lit(False)), "n_chars": F.length("normalized")})
