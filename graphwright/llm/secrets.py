"""Secret scans: fixed credential patterns plus values that are costly to guess.

Base kinds (leftmost, non-overlapping, per kind): ``assign``, ``access``, ``hex``.
The method adds ``guess`` spans: a value in a credential context (a key that holds a
credential word, then a separator with any spaces, then the value, up to its closing
quote where it is quoted) whose cheapest segmentation into common
words, dates, repeats, keyboard walks and brute-force characters costs at least
10 ** ``LEAST_LOG10`` guesses.  The dynamic programme is over prefixes of the
value; it is linear in the value's length times the longest table word.  The words are a short list of
password words and, where its file is given, the letter tokens of a ranked public vocabulary.

Spans are code points, the whole match, end exclusive; base spans are never
dropped; a guess span that one base span covers is left out, one that a base span
only touches stays beside it, and ``mask`` merges them.

Defined results: null and empty texts have no spans; whole texts are scanned,
however long; repeated rows and equal texts get equal spans; ties in cost do not
matter (only the cost is used); an empty table gives no rows; other columns are
ignored, or returned unchanged by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm.arrow import map_small

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN = 12
KINDS = ("assign", "access", "hex", "guess")

#: A credential word inside a key; ``pass`` and ``auth`` alone must not go on as another word (passage, author).
WORD = re.compile(r"password|passwd|passphrase|passcode|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|(?:pass|auth)(?![a-z])", re.I | re.A)
SEPARATOR = re.compile(r"(=>|:=|[:=])\x20*+")
#: A quoted value reaches to its closing quote on the same line; a backslash takes the next character along.
QUOTED = re.compile(r""""((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'""")
PLAIN = re.compile(r"""["']?([^\s"'<>,;]+)""")
_KEY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
LEAST_VALUE = 8
#: log10 of the guesses from which a value counts as a secret.
LEAST_LOG10 = 11.0

#: Common password words, most frequent first; the rank is the guess cost. Fixed values.
WORDS = (
    "password passwd secret token admin root user login welcome letmein master monkey dragon shadow sunshine princess "
    "football baseball superman batman trustno hello freedom whatever qazwsx michael jordan hunter buster soccer harley "
    "ranger daniel george summer winter spring autumn test demo example sample change default guest public private none "
    "null true false value string here your this that the and for with api key access auth bearer basic localhost server "
    "database production staging please enter insert todo placeholder redacted hidden unknown undefined required optional"
).split()
#: Rows of a keyboard, for walks. Fixed values.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")



class Words:
    """Guess costs of words: ``WORDS`` first, then the letter tokens of a ranked vocabulary (a ``.tiktoken`` file), most frequent first."""

    def __init__(self, ranks: str | None = None):
        listed = list(WORDS)
        if ranks:
            with open(ranks, "rb") as lines:
                tokens = (base64.b64decode(line.split()[0]).strip().lower() for line in lines if line.strip())
                listed += [t.decode() for t in tokens if len(t) > 2 and t.isascii() and t.isalpha()]
        self.cost: dict[str, float] = {}
        for word in listed:
            self.cost.setdefault(word, math.log10(len(self.cost) + 2))
        self.longest = max(map(len, self.cost))


_COMMON = Words()


@lru_cache(maxsize=4)
def words_of(ranks: str | None) -> Words:
    """The table of a vocabulary file, read once a worker."""
    return Words(ranks) if ranks else _COMMON


_STEPS = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {b + a for row in ROWS for a, b in zip(row, row[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d")
#: log10 guesses of one brute-force character; letters inside a run of letters are word-like and cheaper.
_CHAR, _LETTER = 1.0, 0.6


def _run_ends(value: str, joined) -> list[int]:
    """For every start, the end of the longest stretch whose neighbours are all joined."""
    ends = [len(value)] * len(value)
    for i in range(len(value) - 2, -1, -1):
        ends[i] = ends[i + 1] if joined(value[i], value[i + 1]) else i + 1
    return ends


def guess_cost(value: str, words: Words = _COMMON) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs."""
    return _kept_cost(value, words) if len(value) <= 256 else _cost(value, words)


@lru_cache(maxsize=4096)
def _kept_cost(value: str, words: Words) -> float:
    return _cost(value, words)


def _cost(value: str, words: Words) -> float:
    low, n = value.lower(), len(value)
    if not n:
        return 0.0
    best = [0.0] + [math.inf] * n
    repeats = _run_ends(low, lambda a, b: a == b)
    walks = _run_ends(low, lambda a, b: a + b in _STEPS)
    for i in range(n):
        base = best[i]

        def offer(end: int, cost: float, base: float = base) -> None:
            if base + cost < best[end]:
                best[end] = base + cost

        letter = low[i].isalpha() and (i > 0 and low[i - 1].isalpha() or i + 1 < n and low[i + 1].isalpha())
        offer(i + 1, _LETTER if letter else _CHAR)
        for end in range(i + 3, min(n, i + words.longest) + 1):
            rank = words.cost.get(low[i:end])
            if rank is not None:
                offer(end, rank + (0.3 if value[i:end] != low[i:end] else 0.0) + 0.3)
        if repeats[i] - i >= 3:
            offer(repeats[i], _CHAR + math.log10(repeats[i] - i) + 0.3)
        if walks[i] - i >= 3:
            offer(walks[i], 1.5 + math.log10(walks[i] - i) + 0.3)
        date = _DATE.match(low, i)
        if date:
            offer(date.end(), 2.1 if date.end() - i == 4 else 4.6)
    return best[n]


def credential_values(text: str):
    """``(start, end)`` of the values in credential contexts: a key with a credential word, a separator, the value.

    Works from the separators outwards, so that it is linear in the text whatever its runs.
    """
    done = 0
    for m in SEPARATOR.finditer(text):
        stop = m.start()
        if stop < done:  # inside the last value
            continue
        while stop > done and text[stop - 1] == " ":
            stop -= 1
        if stop > done and text[stop - 1] in "\"'":
            stop -= 1
        start = stop
        while start > done and text[start - 1] in _KEY:
            start -= 1
        done = m.end(1)
        if start == stop or not WORD.search(text, start, stop):
            continue
        value = QUOTED.match(text, m.end())
        if value:
            done = value.end()
            yield value.span(value.lastindex)
            continue
        value = PLAIN.match(text, m.end())
        if value:
            a, b = value.span(1)
            done = b
            while b > a and text[b - 1] in ".)]}":
                b -= 1
            yield a, b


def find_spans(text: str | None, words: Words = _COMMON) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of all spans, by start, then kind as listed in ``KINDS``."""
    if not text:
        return []
    spans = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    spans += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    # Both lists are in order of their starts: one walk tells how far the base spans that begin before a value reach.
    base, at, reach = sorted(spans), 0, 0
    for a, b in credential_values(text):
        while at < len(base) and base[at][0] <= a:
            reach = max(reach, base[at][1])
            at += 1
        if b - a >= LEAST_VALUE and reach < b and guess_cost(text[a:b], words) >= LEAST_LOG10:
            spans.append((a, b, "guess"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_SCAN = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"


def scan(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans as text.

    ``ranks``: a ranked vocabulary (``.tiktoken``) whose words the guess cost knows besides ``WORDS``.
    """

    def run(batches):
        words = words_of(ranks)
        for batch in batches:
            found = [find_spans(t, words) for t in batch.column(1).to_pylist()]
            kinds = [Counter(s[2] for s in spans) for spans in found]
            counts = [[k[kind] for k in kinds] for kind in KINDS]
            base = [hashlib.sha256(_joined([s for s in spans if s[2] != "guess"]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base, pa.string()), pa.array(map(_joined, found), pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"],
            )

    return map_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SCAN)


def mask(text: str | None, words: Words = _COMMON) -> str | None:
    """The text with every span replaced by ``[SECRET]`` (overlapping spans by one)."""
    out, at, end = [], 0, 0
    for start, stop, _ in find_spans(text, words):
        if start >= end:
            out += [text[at:start], "[SECRET]"]
        end = at = max(end, stop)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with secrets masked in ``text``; ``n_chars``, where there is one, follows the new text."""
    place = docs.columns.index("text")

    def run(batches):
        words = words_of(ranks)
        for batch in batches:
            texts = pa.array([mask(t, words) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), texts)

    out = map_small(docs, run, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    kind = dict(docs.dtypes)["n_chars"]
    changed = F.when(F.col("text").contains("[SECRET]"), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed)
