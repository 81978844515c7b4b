"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by a pigeonring join.

Fingerprint (``text_fingerprint``): A-Z lower-cased, words are runs of bytes other
than space and 0x09-0x0D, shingles of four words (repeats included) joined by a
space; a text of fewer words is one shingle, a text without words has
fingerprint 0.  A bit is set if more than half of the shingles' XXH64 (seed 42)
have it.

Link rule: at most ``MAX_BITS`` (4) differing bits, transitively closed.

Join (pigeonring): the 64 bits are a ring of five segments.  If two fingerprints differ in
at most four bits, some segment starts a chain whose first l segments together differ
in at most 4 l / 5 bits, for every l: none in the first, one in the first two, two in
the first three, and so on.  Candidates are made from chains of two: a key is an equal
segment together with two equal thirds of the next one (one bit can spoil only one
third), 15 keys a fingerprint of about 22 bits each.  They are then pruned by the
chain of three from the key's segment, and only survivors get the full Hamming check.
Keys of very many fingerprints are refined by a further equal part of the bits they
leave open (``refined``).  No link is lost and no bucket is capped.

Defined results: null text counts as empty; an empty or word-less text has
fingerprint 0 and links like any other; repeated rows and equal texts share a
fingerprint and a component; a null ``doc_id`` keeps its row, never names a
component unless the whole component lacks ids; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.arrow import map_small, raw_texts
from graphwright.llm.blocks import blocked_rows, merge_labels, stream_blocks
from graphwright.operators.components import contract_components
from graphwright.plans.durable import durable
from graphwright.plans.skew import attach

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Widths of the ring's segments.
SEGMENTS = (13, 13, 13, 13, 12)
#: Bits that chains of one, two, ... segments may differ in.
BUDGETS = tuple((i + 1) * MAX_BITS // len(SEGMENTS) for i in range(len(SEGMENTS)))
#: Parts of a chain's second segment; it may differ in one bit, so all but one part are equal.
PARTS = 3
#: Bytes of one text that are split into words at a time.
TEXT_BLOCK = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = b" \t\n\x0b\x0c\r"


def _word_blocks(data: bytes):
    """Lists of words; a long text comes in blocks that are cut at white space."""
    at = 0
    while at < len(data):
        end = min(at + TEXT_BLOCK, len(data))
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        yield data[at:end].split()
        at = end


def _hashes(words: list[bytes], width: int) -> list[int]:
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(words) - width + 1].tolist()
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def _bit_counts(hashes: list[int]) -> np.ndarray:
    packed = np.array(hashes, np.dtype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(packed, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def text_fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one text (UTF-8 bytes)."""
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for words in _word_blocks(text.translate(_LOWER)):
        tail += words
        if len(tail) >= width:
            hashes = _hashes(tail, width)
            counts += _bit_counts(hashes)
            n += len(hashes)
            tail = tail[len(tail) - width + 1 :]
    if not n:
        if not tail:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id long, fp long)``: the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = [text_fingerprint(t, width) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_small(source, run, "doc_id long, fp long")


def _bits(at: int, width: int) -> int:
    return ((1 << width) - 1) << at


def _segment_masks() -> list[int]:
    ends = np.cumsum(SEGMENTS).tolist()
    return [_bits(end - width, width) for end, width in zip(ends, SEGMENTS, strict=True)]


def _cut(mask: int, parts: int) -> list[int]:
    """The set bits of ``mask`` in so many parts of nearly equal size."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in bits[len(bits) * p // parts : len(bits) * (p + 1) // parts]) for p in range(parts)]


def _key_masks() -> list[int]:
    """The bits that fingerprints of one key share, by tag; tag // PARTS is the first segment of the key's chain."""
    ring = _segment_masks()
    out = []
    for i, first in enumerate(ring):
        second = ring[(i + 1) % len(ring)]
        out += [first | (second & ~part) for part in _cut(second, PARTS)]
    return out


def _chain_masks(length: int) -> np.ndarray:
    """By tag, the bits of the first ``length`` segments of the key's chain."""
    ring = _segment_masks()
    chains = [sum(ring[(i + k) % len(ring)] for k in range(length)) for i in range(len(ring))]
    return np.repeat(np.array(chains, np.uint64), PARTS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(tag: Column, *parts: Column) -> Column:
    """A key with its tag in the lowest four bits."""
    return F.xxhash64(tag, *parts).bitwiseAND(F.lit(-16)).bitwiseOR(tag.cast("long"))


def ring_keys(fp: Column) -> Column:
    """Array of the keys under which candidates meet: the chains of two segments within budget."""
    return F.array(*[_key(F.lit(tag), fp.bitwiseAND(F.lit(_signed(mask)))) for tag, mask in enumerate(_key_masks())])


def refined(rows: DataFrame) -> DataFrame:
    """Rows ``(key, fp)`` under narrower keys: at most ``MAX_BITS`` of five parts of the open bits differ, so one is equal."""
    parts = MAX_BITS + 1
    masks = [[_signed(m) for m in _cut(~mask & _bits(0, 64), parts)] for mask in _key_masks()]
    tag = F.col("key").bitwiseAND(F.lit(15)).cast("int")
    own = F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in masks]), tag + 1)
    part = F.transform(own, lambda m, i: _key(tag, F.col("key"), i, F.col("fp").bitwiseAND(m)))
    return rows.select(F.explode(part).alias("key"), "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def ring_links(a: np.ndarray, b: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints that meet under keys of ``tags`` are linked: the chains of two and three segments first."""
    diff = a ^ b
    alive = np.arange(len(diff))
    for length in (2, 3):
        alive = alive[_popcount(diff[alive] & _chain_masks(length)[tags[alive]]) <= BUDGETS[length - 1]]
    alive = alive[_popcount(diff[alive]) <= MAX_BITS]
    out = np.zeros(len(diff), bool)
    out[alive] = True
    return out


def _star_links(keys: np.ndarray, fps: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Labels by row position: rows of one key that are linked share the least position. Rows are sorted by key."""
    labels = np.arange(len(fps))
    left = np.arange(len(fps))
    shift = 0
    while True:
        shift += 1
        left = left[left + shift < len(fps)]
        left = left[keys[left] == keys[left + shift]]
        if not len(left):
            return labels
        open_ = left[labels[left] != labels[left + shift]]
        if len(open_):
            hit = open_[ring_links(fps[open_], fps[open_ + shift], tags[open_])]
            if len(hit):
                merge_labels(labels, hit, hit + shift)


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """``(u, v)``: stars that connect all distinct fingerprints ``fp`` linked by the rule, linear in the rows."""
    keyed = classes.select(F.explode(ring_keys(F.col("fp"))).alias("key"), "fp")
    blocks = blocked_rows(keyed, "key", "fp", refined)

    def run(batches):
        for table in stream_blocks(batches):
            group = table["group"]
            fps = table["fp"].view(np.uint64)
            labels = _star_links(group, fps, table["gkey"] & 15)
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            if len(moved):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table["fp"][moved]), pa.array(table["fp"][labels[moved]])], names=["u", "v"]
                )

    return blocks.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``; see the module's docstring."""
    prints = durable(fingerprints(docs), "fp")
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    roots = durable(contract_components(fingerprint_links(classes)), "roots")
    named = roots.withColumnRenamed("node", "fp").join(classes, "fp")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(least, "root").select("fp", "component_id")
    groups = classes.join(linked, "fp", "left").where("n > 1 or component_id is not null")
    groups = durable(groups.select("fp", "n", F.coalesce("component_id", "least").alias("component_id")), "groups")
    return attach(prints, groups, "fp", "n").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each component the row of the least doc_id stays.

    ``found`` has the components as ``(doc_id, component_id)``; without it they are those of the link rule.  Of repeated rows with that doc_id one stays; rows with a null doc_id cannot be
    named and stay.  All columns are returned unchanged.
    """
    found = near_duplicates(docs) if found is None else found
    found = durable(found.where("doc_id is not null"), "components")
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__drop")).distinct()
    kept = docs.join(dropped, docs["doc_id"] == F.col("__drop"), "left_anti")
    repeated = durable(
        found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")),
        "again",
    )
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept["doc_id"] == F.col("__again"), "left_anti")
    again = kept.join(repeated, kept["doc_id"] == F.col("__again"), "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again)
