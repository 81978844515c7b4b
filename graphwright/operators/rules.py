"""Rule tables of the reasoner and the verifier. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSITIVE = ("is-a", "part-of", "contains", "implies", "causes")
SYMMETRIC = ("similar-to", "related-to", "connected-with", "interacts-with")
INVERSE = (
    ("contains", "part-of"), ("broader-than", "narrower-than"), ("causes", "caused-by"), ("precedes", "follows"),
    ("parent-of", "child-of"), ("works-for", "employs"),
)
CHAIN = ("has-skill", "required-for", "qualified-for")
PATH_TRANSITIVE = ("is-a", "part-of", "contains", "causes", "implies")
HIERARCHY = ("is-a", "part-of", "contains")
#: Opposites as the reasoner sees them.
REASONER_OPPOSITES = {
    "works-for": ("not-affiliated-with", "unrelated-to"), "is-a": ("is-not-a", "different-from"),
    "part-of": ("separate-from", "not-part-of"), "contains": ("does-not-contain", "excludes"),
    "causes": ("prevents", "unrelated-to"), "before": ("after", "simultaneous-with"), "implies": ("contradicts", "unrelated-to"),
}
#: Opposites as the verifier sees them.
VERIFIER_OPPOSITES = {
    "is-a": ("is-not-a", "different-from"), "part-of": ("separate-from", "unrelated-to"), "causes": ("prevents", "unrelated-to"),
    "depends-on": ("independent-of",), "similar-to": ("different-from", "opposite-of"),
    "greater-than": ("less-than", "equal-to"), "before": ("after", "simultaneous-with"),
}
VERIFIER_HIERARCHY = ("is-a", "part-of", "subclass-of", "contains", "includes")
VERIFIER_TRANSITIVE = ("is-a", "part-of", "subclass-of")
VERIFIER_DENIALS = ("is-not-a", "different-from", "separate-from")


def canonical_type(relation: Column, strict: bool = False) -> Column:
    """Relation type as rules spell it: lower case, hyphens for underscores and spaces; ``strict`` only lowers."""
    return F.lower(relation) if strict else F.translate(F.lower(relation), "_ ", "--")


def opposite_pairs(table: dict[str, tuple[str, ...]]) -> set[tuple[str, str]]:
    """The table closed under inversion."""
    pairs = {(a, b) for a, others in table.items() for b in others}
    return pairs | {(b, a) for a, b in pairs}


def inverse_pairs() -> set[tuple[str, str]]:
    return set(INVERSE) | {(b, a) for a, b in INVERSE}


def pair_frame(spark: SparkSession, pairs: set[tuple[str, str]], left: str, right: str) -> DataFrame:
    """A rule table as a frame to broadcast; its size is that of the rule list."""
    return F.broadcast(spark.createDataFrame(sorted(pairs), f"{left} string, {right} string"))
