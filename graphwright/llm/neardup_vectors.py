"""Embedding near-duplicates: E8 lattice hashing in several tables, verified by cosine.

Each table projects a unit vector onto two random 8-dimensional subspaces and
decodes both to E8 lattice points; the pair of points is its home cell.  A vector
is stored in its home cell and probes its home and the nearest neighbouring cells
of every table.  Rows travel to cells as 128-bit sign sketches first; only where
a sketch has company in its cell does the vector follow, so what is shuffled is a
few times the input and not a vector per probe.  A pair met in any table is verified by its cosine in double
precision; links are closed transitively.

Equal vectors are one class first.  Cells of any size are compared in bounded
blocks by matrix products; a task gives per vector a count and one edge of a
spanning star, so rows stay linear in the input.  A pair counts where it meets
first (lowest table, home of the lower id first), which both vectors' cells tell,
so no list of pairs is ever shuffled.

Recall against brute force at the threshold itself is about 0.98 (``tests/llm``
holds it above 0.95); it rises quickly above.  No pair below the threshold is linked.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component; vectors of different lengths
never link, those of one length do, however many lengths there are; any finite magnitude
counts (vectors are divided by their largest component before their norm); equal
vectors link; repeated rows count as vectors of their own; a row with a null ``vec_id``
links and is counted, but names no component (one of such rows alone has a null one) and
is not kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm.blocks import blocked_rows, merge_labels, stream_blocks
from graphwright.llm.lattice import near_points
from graphwright.operators.components import contract_components
from graphwright.plans.durable import durable
from graphwright.plans.skew import attach

LEAST_COSINE = 0.9
TABLES, PROBES = 8, 4
SUBSPACES, NEIGHBOURS = 2, 5
#: Lattice spacing for unit vectors of 64 dimensions; scaled with the square root of others.
WIDTH = 0.3
SEED = 20_240
#: Differing signs of 128 up to which two sketches may belong to linked vectors: 18 are expected at the threshold
#: (standard deviation 4; one pair in ten million has more than 40) and 64 between unrelated vectors.
SKETCH_BITS = 40
#: Pairs whose cells are compared at a time.
PAIRS = 1 << 18


@cache
def _projections(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Per table dims x (8 SUBSPACES) orthonormal columns, scaled to lattice units; and odd hash multipliers."""
    rng = np.random.default_rng(SEED + dims)
    places = 8 * SUBSPACES
    rows = max(dims, places)
    frames = [np.linalg.qr(rng.normal(size=(rows, places)))[0][:dims] for _ in range(TABLES)]
    return np.stack(frames) * np.sqrt(dims / 64) / WIDTH, rng.integers(1, 2**62, size=(TABLES, places)) | 1


def cells(unit: np.ndarray) -> np.ndarray:
    """rows x TABLES x PROBES cell codes of unit vectors; the first of each table is the home cell."""
    frames, mix = _projections(unit.shape[1])
    out = np.empty((len(unit), TABLES, PROBES), np.int64)
    for t in range(TABLES):
        y = unit @ frames[t]
        # Vectors of another length are in cells of their own.
        codes, costs = np.full((len(unit), 1), t + TABLES * unit.shape[1], np.int64), np.zeros((len(unit), 1))
        for s in range(SUBSPACES):
            points, cost = near_points(y[:, 8 * s : 8 * s + 8], NEIGHBOURS)
            hashed = (np.rint(2 * points).astype(np.int64) * mix[t, 8 * s : 8 * s + 8]).sum(axis=2)
            codes = (codes[:, :, None] * np.int64(0x9E3779B97F4A7C1) + hashed[:, None, :]).reshape(len(unit), -1)
            costs = (costs[:, :, None] + cost[:, None, :]).reshape(len(unit), -1)
        codes ^= codes >> np.int64(29)
        nearest = np.argsort(costs, axis=1, kind="stable")[:, :PROBES]
        out[:, t] = np.take_along_axis(codes, nearest, axis=1)
    return out


def sketches(unit: np.ndarray) -> np.ndarray:
    """rows x 2 words of the signs of 128 random projections."""
    axes = np.random.default_rng(SEED - 1).normal(size=(unit.shape[1], 128))
    return np.packbits(unit @ axes > 0, axis=1).view(np.int64)


def _unit(raw: np.ndarray, kind: str) -> np.ndarray:
    values = np.ascontiguousarray(raw).view(kind).astype(np.float64)
    values /= np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def valid_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(vec_id, vec)``: the components as bytes, null where the vector cannot link."""
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))

    def run(batches):
        for batch in batches:
            out = []
            for value in batch.column(1):
                items = value.values
                vec = None
                if items is not None and len(items) and items.null_count == 0:
                    x = items.to_numpy(zero_copy_only=False)
                    if np.isfinite(x).all() and x.any():
                        vec = (x + 0.0).tobytes()
                out.append(vec)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    return source.mapInArrow(run, "vec_id long, vec binary")


def _by_length(batch: pa.RecordBatch, kind: str):
    """``(reps, unit vectors)`` of each length in a batch of (rep, vec)."""
    reps, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    widths = np.fromiter(map(len, raw), np.int64, len(raw))
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        yield reps[own], _unit(np.frombuffer(b"".join(raw[i] for i in own), np.uint8).reshape(len(own), -1), kind)


def _placed(classes: DataFrame, kind: str) -> DataFrame:
    """Every class in each cell it probes, whether the cell is its home, and its sign sketch instead of the vector."""

    def run(batches):
        for batch in batches:
            for reps, unit in _by_length(batch, kind):
                codes, signs = cells(unit), sketches(unit)
                for t in range(TABLES):
                    for p in range(PROBES):
                        key = pa.array(codes[:, t, p])
                        table, home = pa.array(np.full(len(unit), t, np.int32)), pa.array(np.full(len(unit), p == 0))
                        yield pa.RecordBatch.from_arrays(
                            [key, table, home, pa.array(reps), pa.array(signs[:, 0]), pa.array(signs[:, 1])],
                            names=["key", "tab", "home", "rep", "s1", "s2"],
                        )

    return classes.select("rep", "vec").mapInArrow(run, "key long, tab int, home boolean, rep long, s1 long, s2 long")


def _with_company(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows meet, in their cell, another with a sketch close enough, one of the two at home."""
    group, home = rows["group"], rows["home"].astype(bool)
    s1, s2 = rows["s1"].view(np.uint64), rows["s2"].view(np.uint64)
    found, left, shift = np.zeros(len(group), bool), np.arange(len(group)), 0
    while True:
        shift += 1
        left = left[left + shift < len(group)]
        left = left[group[left] == group[left + shift]]
        if not len(left):
            return found
        i = left[~(found[left] & found[left + shift])]
        i = i[home[i] | home[i + shift]]
        near = np.bitwise_count(s1[i] ^ s1[i + shift]).astype(np.int16) + np.bitwise_count(s2[i] ^ s2[i + shift]) <= SKETCH_BITS
        found[i[near]] = found[i[near] + shift] = True


def _candidates(classes: DataFrame, kind: str) -> DataFrame:
    """The places of :func:`_placed` worth a vector: those with company by sketch; ``(key, tab, home, rep, vec, n)``."""

    def run(batches):
        for rows in stream_blocks(batches):
            keep = np.flatnonzero(_with_company(rows))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(rows[c][keep]) for c in ("gkey", "tab", "home", "rep")], names=["key", "tab", "home", "rep"])

    places = blocked_rows(_placed(classes, kind), "key", "rep").mapInArrow(run, "key long, tab int, home boolean, rep long")
    # A row of a large cell is seen in several block pairs.
    return durable(places.distinct(), "places").join(classes, "rep").select("key", "tab", "home", "rep", "vec", "n", F.octet_length("vec").alias("dims"))


def _pairs(group: np.ndarray, start: np.ndarray, stop: np.ndarray, unit: np.ndarray, rows: dict[str, np.ndarray], least: float):
    """Index pairs that meet in a cell, one of them at home, with cosine of at least ``least``."""
    home, own, apart = rows["home"], rows["own"], rows["gs"] != rows["gt"]
    for a, b in zip(start, stop, strict=True):
        if not home[a:b].any():
            continue
        for at in range(a, b, 512):
            end = min(at + 512, b)
            i, j = np.nonzero(unit[at:end] @ unit[a:b].T >= least - 1e-9)
            i, j = i + at, j + a
            keep = (i < j) & (home[i] | home[j])
            if apart[a]:
                keep &= own[i] != own[j]
            i, j = i[keep], j[keep]
            if len(i):
                exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
                yield i[exact], j[exact]


def _first_meeting(i: np.ndarray, j: np.ndarray, codes: np.ndarray, first: np.ndarray, table: int, key: int) -> np.ndarray:
    """Which pairs (i, j) meet in ``table`` at cell ``key`` for the first time; ``first``: i has the lower id."""
    low, high = np.where(first, i, j), np.where(first, j, i)
    at_low = lambda a, b, t: (codes[b, t] == codes[a, t, :1]).any(axis=1)  # noqa: E731  b probes the home of a
    alive = np.ones(len(i), bool)
    for t in range(table):
        open_ = np.flatnonzero(alive)
        a, b = low[open_], high[open_]
        alive[open_] = ~(at_low(a, b, t) | at_low(b, a, t))
    open_ = np.flatnonzero(alive)
    a, b = low[open_], high[open_]
    alive[open_] = key == np.where(at_low(a, b, table), codes[a, table, 0], codes[b, table, 0])
    return alive


def class_links(classes: DataFrame, kind: str, least: float = LEAST_COSINE) -> DataFrame:
    """``(rep, links, root)``: links counted per place of comparison, and a star that connects what is linked there."""
    blocks = blocked_rows(_candidates(classes, kind), "key", "rep")

    def run(batches):
        for rows in stream_blocks(batches):
            group, rep = rows["group"], rows["rep"]
            unit = _unit(rows["vec"], kind)
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            labels, links = np.arange(len(rep)), np.zeros(len(rep), np.int64)
            codes = np.zeros((0, TABLES, PROBES), np.int64)
            place = np.full(len(rep), -1)
            for i, j in _pairs(group, start, np.r_[start[1:], len(group)], unit, rows, least):
                new = np.unique(np.r_[i, j])
                new = new[place[new] < 0]
                if len(new):
                    place[new] = len(codes) + np.arange(len(new))
                    codes = np.concatenate([codes, cells(unit[new])])
                for at in range(0, len(i), PAIRS):
                    a, b = i[at : at + PAIRS], j[at : at + PAIRS]
                    here = _first_meeting(place[a], place[b], codes, rep[a] < rep[b], int(rows["tab"][a[0]]), rows["gkey"][a[0]])
                    a, b = a[here], b[here]
                    np.add.at(links, a, rows["n"][b])
                    np.add.at(links, b, rows["n"][a])
                    merge_labels(labels, a, b)
            found = np.flatnonzero(links)
            if len(found):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[found]), pa.array(links[found]), pa.array(rep[labels[found]])], names=["rep", "links", "root"]
                )

    return blocks.mapInArrow(run, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``; see the module's docstring."""
    kind = "f8" if "double" in dict(vectors.dtypes)[embedding] else "f4"
    base = durable(valid_vectors(vectors, vec_id, embedding), "vectors")
    classes = base.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    # Numbers of the classes are settled once this is written.
    classes = durable(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    linked = durable(class_links(classes, kind, least), "linked")
    roots = durable(contract_components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v"))), "roots")
    named = roots.withColumnRenamed("node", "rep").join(classes.select("rep", "least"), "rep")
    names = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("rep", "component_id")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    facts = classes.join(counts, "rep", "left").join(names, "rep", "left").where("n > 1 or links is not null")
    facts = durable(
        facts.select("vec", F.col("n").alias("rows"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")),
        "facts",
    )
    out = attach(base, facts, "vec", "rows")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
