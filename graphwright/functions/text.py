"""Text scalar functions as column expressions (JVM-side, whole-stage friendly)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO_WIDTH = "[\\u200B-\\u200D\\uFEFF]"
CODE_MARKERS = ("{}", "[]", ";", "==", "=", "//", "/*", "*/", "function", "def ", "class ")
#: Markdown rewrites in order: (pattern, replacement). Links run before images. Fixed values.
MARKDOWN = (
    (r"(?m)^#+(?U:\s)+", ""), (r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1"), (r"__(.*?)__", "$1"), (r"_(.*?)_", "$1"),
    (r"```(?:[^`]*)\n([\s\S]*?)\n```", "$1"), (r"`([^`]*)`", "$1"), (r"\[(.*?)\]\(.*?\)", "$1"), (r"!\[(.*?)\]\(.*?\)", "$1"),
    (r"(?m)^-{3,}$", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""),
)


def strip(text: Column) -> Column:
    """Without white space at both ends (any Unicode white space)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_loaded(text: Column) -> Column:
    """White space runs to one space, zero-width characters removed, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), _ZERO_WIDTH, ""))


def normalize_text(text: Column) -> Column:
    """Line ends to LF, three or more LF to two, blanks to one space, lines and text trimmed; null is empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), "[ \t]+", " ")
    return strip(F.array_join(F.transform(F.split(out, "\n"), strip), "\n"))


def paragraphs(text: Column) -> Column:
    """Array of the non-blank paragraphs of the normalised text."""
    return F.filter(F.split(normalize_text(text), "\n\n+"), lambda p: strip(p) != "")


def truncate(text: Column, most: int, ellipsis: bool = True) -> Column:
    """Cut at ``most`` characters, back to the last space unless that is the first character; short texts unchanged."""
    cut = F.substring(text, 1, most)
    word = F.regexp_extract(cut, "(?s)^(.+) ", 1)
    out = F.when(word != "", word).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(out, F.lit("..." if ellipsis else "")))


def approximate_tokens(text: Column, chars_per_token: int = 4) -> Column:
    """At least 1 for any text, 0 for an empty or null one."""
    n = F.floor(F.length(strip(text)) / chars_per_token).cast("bigint")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), n))


def pack_paragraphs(text: Column, most: int = 1000) -> Column:
    """Greedy packing of paragraphs: array of ``(id, text, position, length)``.

    A segment is closed when the next paragraph does not fit; ``position`` advances
    by the length of the paragraph that opens the next segment plus two.
    """
    closed = "array<struct<text:string,position:int>>"
    start = F.struct(F.array().cast(closed).alias("done"), F.lit("").alias("cur"), F.lit(0).alias("pos"))

    def step(state: Column, p: Column) -> Column:
        cur, pos = state["cur"], state["pos"]
        full = (F.length(cur) + F.length(p) + 2 > most) & (cur != "")
        done = F.when(full, F.array_append(state["done"], F.struct(cur.alias("text"), pos.alias("position")))).otherwise(state["done"])
        text_ = F.when(full | (cur == ""), p).otherwise(F.concat(cur, F.lit("\n\n"), p))
        return F.struct(done.cast(closed).alias("done"), text_.alias("cur"), F.when(full, pos + F.length(p) + 2).otherwise(pos).alias("pos"))

    def finish(state: Column) -> Column:
        last = F.array_append(state["done"], F.struct(state["cur"].alias("text"), state["pos"].alias("position")))
        rows = F.when(state["cur"] != "", last).otherwise(state["done"])
        return F.transform(rows, lambda r, i: F.struct(F.concat(F.lit("seg_"), i + 1).alias("id"), r["text"].alias("text"), r["position"].alias("position"), F.length(r["text"]).alias("length")))

    return F.aggregate(paragraphs(text), start, step, finish)


def best_split_point(text: Column, target: int) -> Column:
    """Where to split near ``target``: the nearest sentence end within 100 characters, else word end, else ``target``."""
    sentence, word = re.compile(r"[.!?]\s+"), re.compile(r"\s+")

    low = max(0, target - 100)

    def one(window: str) -> int:
        for pattern in (sentence, word):
            ends = [m.end() + low for m in pattern.finditer(window)]
            if ends:
                return min(ends, key=lambda e: abs(e - target))
        return target

    @F.pandas_udf("int")
    def split_at(windows: pd.Series) -> pd.Series:
        return windows.map(one, na_action="ignore").astype("Int32")

    # Only the characters around the target go to Python.
    size = F.length(text)
    return F.when(size <= target, size).when(size > target, split_at(F.substring(text, low + 1, target + 100 - low)))


def strip_markdown(text: Column) -> Column:
    """Markdown markup removed in a fixed order, then normalised."""
    out = F.coalesce(text, F.lit(""))
    for pattern, replacement in MARKDOWN:
        out = F.regexp_replace(out, pattern, replacement)
    return normalize_text(out)


def is_natural_language(text: Column) -> Column:
    """No code markers, few special characters, a sentence, and words of 3 to 10 characters on average."""
    cleaned = F.regexp_replace(text, r"""(?U)[\s\.,;:!?'"()\[\]{}]""", "")
    special = F.length(F.regexp_replace(cleaned, r"[\p{L}\p{N}]", ""))
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    mean = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / F.size(words)
    marked = F.lit(False)
    for marker in CODE_MARKERS:
        marked = marked | F.contains(text, F.lit(marker))
    return (
        F.when(text.isNull() | (F.length(text) < 10), False)
        .when(marked, False)
        .when((F.length(cleaned) > 0) & (special / F.length(cleaned) > 0.3), False)
        .when(F.size(words) == 0, False)
        .otherwise(text.rlike("[A-Z\\u0410-\\u042F].*?[.!?]") & mean.between(3, 10))
    )


def outermost_json(text: Column, array: bool = False) -> Column:
    """The outermost ``{...}`` (or ``[...]``) of a model's answer; null where there is none."""
    found = F.regexp_extract(text, r"(?s)\[.*\]" if array else r"(?s)\{.*\}", 0)
    return F.when(found != "", found)
