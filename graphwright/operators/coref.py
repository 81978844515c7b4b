"""Coreference: similar names within a type, greedy star groups, merging, and the id mapping."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import replace
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.operators.graph import KG
from graphwright.operators.name_scores import edits, matches
from graphwright.operators.provider import Provider
from graphwright.operators.registry import merge_groups, normalize_name, repoint
from graphwright.plans.durable import durable

THRESHOLD = 0.7
#: Names of a block, and bins that their characters are counted in.
BLOCK, BINS = 1024, 128
#: Sweeps of first names over the free ones before the rest is compared pair by pair.
SWEEPS = 6
#: Entities of a unit of one name, and entities of a block for each of its ``BLOCK`` units.
UNIT, MEMBERS = 64, 8
#: Entities that meet in a row of scores, and pairs of them after which rows leave a comparison.
LEFTS, RIGHTS, CELLS = 8, 512, 1 << 18


def name_ratio(a: Column, b: Column) -> Column:
    """``SequenceMatcher.ratio`` of two names (order matters)."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        out, known = np.full(len(x), np.nan), np.flatnonzero((x.notna() & y.notna()).to_numpy())
        p, q, place = x.iloc[known].tolist(), y.iloc[known].tolist(), np.arange(len(known))
        whole = np.fromiter(map(len, p), np.int64, len(p)) + np.fromiter(map(len, q), np.int64, len(q))
        out[known] = np.where(whole == 0, 1.0, 2.0 * matches(p, q, place, place) / np.maximum(whole, 1))
        return pd.Series(out)

    return ratio(a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 1 for two empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _bags(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and how often each of ``BINS`` hashed characters occurs in each name."""
    lengths = np.fromiter(map(len, names), np.int64, len(names))
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4")
    place = np.repeat(np.arange(len(names)), lengths) * BINS + codes % BINS
    return lengths, np.bincount(place, minlength=len(names) * BINS).reshape(len(names), BINS).astype(np.int16)


def _may_be_similar(a: list[str], b: list[str], threshold: float, measure: str) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that lengths and common characters do not rule out; no similar pair is ruled out.

    Matched characters of ``ratio``, and characters that edits leave in place, are common to both names.
    """
    if a and b:
        both, longest = [*a, *b], max(map(len, [*a, *b]))
        # What all names start with may be enough for each pair of them.
        if len(os.path.commonprefix([min(both), max(both)])) >= threshold * longest:
            return np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
    (la, ca), (lb, cb) = _bags(a), _bags(b)
    shared = ca.any(axis=0) & cb.any(axis=0)
    ca, cb = ca[:, shared], cb[:, shared]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(len(a)):
        least = threshold * (la[i] + lb) / 2 if measure == "ratio" else threshold * np.maximum(la[i], lb)
        j = np.flatnonzero(np.minimum(la[i], lb) >= least - 1e-9)
        j = j[np.minimum(ca[i], cb[j]).sum(axis=1) >= least[j] - 1e-9]
        found.append((np.full(len(j), i), j))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def similar_names(names: DataFrame, threshold: float, measure: str) -> DataFrame:
    """``(entity_type, n1, n2, similarity)`` of different names of one type, both ways round; ``names``: distinct ``(entity_type, n)``.

    The names of a type lie in hash blocks of about ``BLOCK`` names, and every pair of blocks is compared in
    one place, so that a type of any size takes bounded memory; only pairs that pass the bound leave it.
    """
    sizes = names.groupBy("entity_type").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = names.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, "entity_type").withColumn("own", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("entity_type", "n", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(table: pa.Table) -> pa.Table:
        own, n = table.column("own").to_numpy(), table.column("n").to_pylist()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        left, right = [x for x, o in zip(n, own, strict=True) if o == low], [x for x, o in zip(n, own, strict=True) if o == high]
        i, j = _may_be_similar(left, right, threshold, measure)
        keep = i < j if low == high else slice(None)
        i, j = i[keep].tolist(), j[keep].tolist()
        return pa.table({"entity_type": pa.array([table.column("entity_type")[0].as_py()] * len(i), pa.string()), "n1": pa.array([left[x] for x in i], pa.string()), "n2": pa.array([right[x] for x in j], pa.string())})

    pairs = placed.groupBy("entity_type", "low", "high").applyInArrow(compare, "entity_type string, n1 string, n2 string")
    both = pairs.unionByName(pairs.select("entity_type", F.col("n2").alias("n1"), F.col("n1").alias("n2"))) if measure == "ratio" else pairs
    score = name_ratio(F.col("n1"), F.col("n2")) if measure == "ratio" else edit_similarity(F.col("n1"), F.col("n2"))
    scored = both.withColumn("similarity", score).where(F.col("similarity") >= threshold)
    return scored if measure == "ratio" else scored.unionByName(scored.select("entity_type", F.col("n2").alias("n1"), F.col("n1").alias("n2"), "similarity"))


def _names(entities: DataFrame) -> DataFrame:
    return durable(entities.where("name is not null and entity_type is not null").select("id", "entity_type", "ord", normalize_name(F.col("name")).alias("n")), "names")


def _unit_blocks(entities: DataFrame) -> DataFrame:
    """``(entity_type, blocks, own, n, members)``: units, each of about ``UNIT`` entities of a name at most, in hash blocks.

    So neither a type full of names nor a name full of entities is gathered in one place.
    """
    kind = ["entity_type", "n"]
    names = _names(entities.where("id is not null and ord is not null"))
    heavy = names.groupBy(*kind).agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("parts")).where("parts > 1")
    names = names.join(heavy, kind, "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int"))
    units = durable(names.groupBy(*kind, "part").agg(F.collect_list(F.struct("ord", "id")).alias("members")), "units")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.size("members")) / (MEMBERS * BLOCK)))
    sizes = units.groupBy("entity_type").agg(blocks.cast("int").alias("blocks"))
    placed = units.join(F.broadcast(sizes) if sizes.count() < 10_000 else sizes, "entity_type")
    return placed.select("entity_type", "blocks", F.pmod(F.xxhash64("n", "part"), F.col("blocks")).cast("int").alias("own"), "n", "members")


def similar_pairs(entities: DataFrame, threshold: float = THRESHOLD, measure: str = "ratio", digits: int | None = None) -> DataFrame:
    """``(id1, id2, ord1, ord2, similarity)`` of entities of one type whose lower-case names are similar; id1 is the earlier.

    Every pair is a row, so entities of alike names are quadratic in the result; grouping goes by
    :func:`similar_groups`, which does not list them.  Similarities are computed, and rounded to ``digits`` if that is
    given, once for two units and not for each pair of their entities.
    """
    scored = _block_scores(_unit_blocks(entities), threshold, measure, digits)
    each = scored.select("scores", "ids2", "ords2", F.explode("lefts").alias("l")).select("scores", "ids2", "ords2", F.col("l.id").alias("id1"), F.col("l.ord").alias("ord1"), "l.k")
    both = each.select("scores", "ords2", "id1", "ord1", "k", F.posexplode("ids2").alias("at", "id2")).where(F.get("k", "at") >= 0)
    return both.select("id1", "id2", "ord1", F.get("ords2", "at").alias("ord2"), F.get("scores", F.get("k", "at")).alias("similarity"))


def _parts(df: DataFrame) -> int:
    """Parts that pairs of blocks are dealt to: many, as a part's pairs of blocks are its rows and chance deals them out."""
    return 16 * df.sparkSession.sparkContext.defaultParallelism


def _block_scores(units: DataFrame, threshold: float, measure: str, digits: int | None) -> DataFrame:
    """``(scores, ids2, ords2, lefts)``: up to ``LEFTS`` entities of one block and up to ``RIGHTS`` that each of them meets.

    Each left one has in ``k`` the place in ``scores`` of its similarity with each of ``ids2``, -1 where that is not similar or
    not later.  So few pairs are in a row because the generated loop that lists them holds all of them at once.
    """
    other = units.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != own")
    met = other.select("entity_type", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "n", "members")
    met = met.unionByName(units.select("entity_type", F.col("own").alias("low"), F.col("own").alias("high"), "own", "n", "members"))
    out = "scores array<double>, ids2 array<string>, ords2 array<bigint>, lefts array<struct<id:string,ord:bigint,k:array<int>>>"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        a = _Side(table.filter(pc.equal(table["own"], low)))
        if low == high:
            scores, forth, _ = _unit_scores(a, a, threshold, measure, digits)
            ways = [(a, a, forth, a.done())]
        else:
            b = _Side(table.filter(pc.equal(table["own"], high)))
            scores, forth, back = _unit_scores(a, b, threshold, measure, digits)
            ways = [(a, b, forth, a.earlier(b)[0]), (b, a, np.ascontiguousarray(back.T), a.earlier(b)[1])]
        for x, y, places, start in ways:
            tiles, cells = [], 0
            for left, right in _meetings(x, y, places >= 0):
                right = right[np.searchsorted(right, start[left[0]]) :]
                k = np.take(places[x.unit[left]], y.unit[right], axis=1)
                # Lefts are in order, so only the first of the others may be earlier than some of them.
                some = np.searchsorted(right, start[left[-1]])
                k[:, :some][right[:some] < start[left][:, None]] = -1
                tiles += [(left, right[n : n + RIGHTS], k[:, n : n + RIGHTS]) for n in range(0, len(right), RIGHTS)]
                cells += k.size
                if cells >= CELLS:
                    yield _rows_of(x, y, scores, tiles)
                    tiles, cells = [], 0
            if tiles:
                yield _rows_of(x, y, scores, tiles)

    group = ["entity_type", "low", "high"]
    return met.repartition(_parts(units), *group).groupBy(*group).applyInArrow(compare, out)


class _Side:
    """The units of a block by name, and their entities in order with the places of their units."""

    def __init__(self, table: pa.Table) -> None:
        self.n = table["n"].to_pylist()
        members = table["members"].combine_chunks()
        members = members if isinstance(members, pa.Array) else pa.concat_arrays(members.chunks)
        flat, unit = members.flatten(), np.repeat(np.arange(len(members)), members.value_lengths().to_numpy(zero_copy_only=False))
        rows = pa.table({"ord": flat.field("ord"), "id": flat.field("id"), "unit": unit})
        self.rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("ord", "id", "unit")])).combine_chunks()
        self.unit, self.ord, self.id = self.rows["unit"].to_numpy(), self.rows["ord"].to_numpy(), self.rows["id"].combine_chunks()
        self._by_unit = np.argsort(self.unit, kind="stable")
        self._ends = np.cumsum(np.bincount(self.unit, minlength=len(self.n)))
        self.first, self.last = np.full(len(self.n), np.iinfo(np.int64).max), np.full(len(self.n), np.iinfo(np.int64).min)
        np.minimum.at(self.first, self.unit, self.ord)
        np.maximum.at(self.last, self.unit, self.ord)

    def of(self, unit: int) -> np.ndarray:
        """Entities of a unit."""
        return self._by_unit[self._ends[unit - 1] if unit else 0 : self._ends[unit]]

    def done(self) -> np.ndarray:
        """For each entity, how many of the block it does not meet as the earlier one: those before, itself and its like."""
        place, (o, i, u) = np.arange(len(self.unit)), (self.ord, np.array(self.id.to_pylist(), object), self.unit)
        new = np.flatnonzero((o[1:] != o[:-1]) | (i[1:] != i[:-1]) | (u[1:] != u[:-1])) + 1
        return np.append(new, len(place))[np.searchsorted(new, place, side="right")]

    def earlier(self, other: _Side) -> tuple[np.ndarray, np.ndarray]:
        """For each entity, how many of ``other`` are earlier, and for each of ``other``, how many of these are; of equal ones these are."""
        both = pa.concat_tables([self.rows.select(["ord", "id"]), other.rows.select(["ord", "id"])])
        order = pc.sort_indices(both.append_column("side", pa.array(np.arange(len(both)) >= len(self.unit))), [(c, "ascending") for c in ("ord", "id", "side")]).to_numpy()
        right = order >= len(self.unit)
        # Each side is in order, so its entities come in that of their places.
        return np.cumsum(right)[~right], np.cumsum(~right)[right]


def _meetings(x: _Side, y: _Side, similar: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Up to ``LEFTS`` entities of ``x`` and those of ``y`` that they meet, all in order; ``similar``: of units.

    Entities similar to most of ``y`` meet all of it in company, as the others meet those that are similar to their name.
    """
    share = similar @ np.bincount(y.unit, minlength=len(y.n))
    full = share * 2 >= max(1, len(y.unit))
    lefts, rights = np.flatnonzero(full[x.unit]), np.arange(len(y.unit))
    for n in range(0, len(lefts), LEFTS):
        yield lefts[n : n + LEFTS], rights
    for u in np.flatnonzero(~full & (share > 0)):
        left, right = x.of(u), np.flatnonzero(similar[u][y.unit])
        for n in range(0, len(left), LEFTS):
            yield left[n : n + LEFTS], right


def _unit_scores(a: _Side, b: _Side, threshold: float, measure: str, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Similarities from ``threshold`` on and, for each two units, their place there with the first's entities earlier, and with the second's; -1 where less.

    One that no two entities need may be -1.
    """
    i, j = _may_be_similar(a.n, b.n, threshold, measure)
    if a is b:
        i, j = i[i <= j], j[i <= j]
    la, lb = (np.fromiter(map(len, s.n), np.int64, len(s.n)) for s in (a, b))
    # The same arithmetic as that of name_ratio and edit_similarity.
    if measure == "ratio":
        ahead, behind = np.flatnonzero(a.first[i] <= b.last[j]), np.flatnonzero(b.first[j] <= a.last[i])
        found, whole = np.concatenate([matches(a.n, b.n, i[ahead], j[ahead]), matches(b.n, a.n, j[behind], i[behind])]), la[i] + lb[j]
        whole = np.concatenate([whole[ahead], whole[behind]])
    else:
        found, whole = edits(a.n, b.n, i, j), np.maximum(la[i], lb[j])
    most = found.max(initial=0) + 1
    kinds, kind = _distinct(whole * most + found)
    whole, found = np.divmod(kinds, most)
    with np.errstate(invalid="ignore", divide="ignore"):
        scores = np.where(whole == 0, 1.0, 2.0 * found / whole if measure == "ratio" else 1 - found / whole)
    similar = scores >= threshold
    kind = np.where(similar, np.cumsum(similar) - 1, -1).astype(np.int32)[kind]
    scores = scores[similar]
    if digits is not None:
        scores = np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in scores], np.float64)
    forth = np.full((len(a.n), len(b.n)), -1, np.int32)
    if measure != "ratio":
        forth[i, j] = kind
        if a is b:
            forth[j, i] = kind
        return scores, forth, forth
    if a is b:
        # Entities of either unit may be the earlier ones; the later of a pair is always on the right.
        forth[j[behind], i[behind]] = kind[len(ahead) :]
        forth[i[ahead], j[ahead]] = kind[: len(ahead)]
        return scores, forth, forth
    back = np.full_like(forth, -1)
    forth[i[ahead], j[ahead]], back[i[behind], j[behind]] = kind[: len(ahead)], kind[len(ahead) :]
    return scores, forth, back


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the place of each value among them, counted where no value is large."""
    if values.max(initial=0) >= 1 << 20:
        return np.unique(values, return_inverse=True)
    there = np.bincount(values) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[values]


def _rows_of(x: _Side, y: _Side, scores: np.ndarray, tiles: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of :func:`_block_scores` from ``(lefts, rights, places of scores)``."""
    lists = lambda sizes, values: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values)
    left, right = (np.concatenate([tile[n] for tile in tiles]) for n in range(2))
    lefts, rights = ([len(tile[n]) for tile in tiles] for n in range(2))
    k = lists(np.repeat(rights, lefts), np.concatenate([tile[2].ravel() for tile in tiles]))
    each = pa.StructArray.from_arrays([x.id.take(pa.array(left)), pa.array(x.ord[left]), k], ["id", "ord", "k"])
    columns = [lists([len(scores)] * len(tiles), np.tile(scores, len(tiles))), lists(rights, y.id.take(pa.array(right))), lists(rights, y.ord[right]), lists(lefts, each)]
    return pa.RecordBatch.from_arrays(columns, ["scores", "ids2", "ords2", "lefts"])


def _near_heads(free: DataFrame, heads: DataFrame, threshold: float, measure: str) -> DataFrame:
    """Pairs ``(id1, id2, ord1, ord2)`` of a head with a later free class of its type that is similar."""
    side = heads.select("entity_type", F.col("n").alias("n1"), F.col("id").alias("id1"), F.col("ord").alias("ord1"))
    both = free.withColumnsRenamed({"n": "n2", "id": "id2", "ord": "ord2"}).join(F.broadcast(side) if side.count() <= 100_000 else side, "entity_type")
    both = both.where("ord1 < ord2 or (ord1 = ord2 and id1 < id2)")
    part = threshold / (2 - threshold) if measure == "ratio" else threshold
    both = both.where(F.least(F.length("n1"), F.length("n2")) >= (part - 1e-9) * F.greatest(F.length("n1"), F.length("n2")))
    score = name_ratio(F.col("n1"), F.col("n2")) if measure == "ratio" else edit_similarity(F.col("n1"), F.col("n2"))
    return both.withColumn("similarity", score).where(F.col("similarity") >= threshold).select("id1", "id2", "ord1", "ord2")


def similar_groups(entities: DataFrame, threshold: float = THRESHOLD, measure: str = "ratio") -> DataFrame:
    """``(id, center)``: :func:`star_groups` of all entities, by way of the names they share.

    Types full of similar names would have a pair for every two of them, although a few centres take them all.  So the
    first names of a type, one, two, four and so on, are compared with all that are still free, in
    ``SWEEPS`` sweeps; what is free after them goes by pairs.
    """
    names = _names(entities)
    classes = durable(names.groupBy("entity_type", "n").agg(F.min(F.struct("ord", "id")).alias("head")), "classes")
    free = durable(classes.select("entity_type", "n", F.col("head.id").alias("id"), F.col("head.ord").alias("ord")), "free")
    taken: list[DataFrame] = []
    for sweep in range(SWEEPS):
        place = Window.partitionBy("entity_type").orderBy("ord", "id")
        heads = durable(free.withColumn("k", F.row_number().over(place)).where(F.col("k") <= 2**sweep).drop("k"), "heads")
        if heads.isEmpty():
            break
        got = durable(star_groups(durable(_near_heads(free, heads, threshold, measure), "near")), "taken")
        taken.append(got)
        left = free.join(heads.select("id"), "id", "left_anti").join(got.select("id"), "id", "left_anti")
        free = durable(left.select("entity_type", "n", "id", "ord"), "free", replaces=free)
    scored = similar_names(free.select("entity_type", "n"), threshold, measure)
    side = lambda k: free.select("entity_type", F.col("n").alias(f"n{k}"), F.col("id").alias(f"id{k}"), F.col("ord").alias(f"ord{k}"))
    pairs = scored.join(side(1), ["entity_type", "n1"]).join(side(2), ["entity_type", "n2"])
    stars = star_groups(pairs.where("ord1 < ord2 or (ord1 = ord2 and id1 < id2)").select("id1", "id2", "ord1", "ord2"))
    for got in taken:
        stars = stars.unionByName(got)
    stars = durable(stars, "stars")
    members = names.join(classes, ["entity_type", "n"]).where(F.col("id") != F.col("head.id")).select("id", F.col("head.id").alias("first"))
    rest = members.join(stars.withColumnRenamed("id", "first"), "first", "left")
    return stars.unionByName(rest.select("id", F.coalesce("center", "first").alias("center")))


def star_groups(pairs: DataFrame) -> DataFrame:
    """``(id, center)``: greedy grouping in order of ``ord``, not transitive; whoever has no pair as the earlier one is no centre.

    An entity becomes a centre unless an earlier centre has taken it; a centre takes
    all its later similar entities that are free.  Rounds decide at once every
    entity that waits for no earlier one.
    """
    key = lambda n: F.struct(F.col(f"ord{n}").alias("o"), F.col(f"id{n}").alias("id"))
    open_ = durable(pairs.select(key(1).alias("a"), key(2).alias("b")), "pairs")
    taken: list[DataFrame] = []
    while not open_.isEmpty():
        waiting = open_.select(F.col("b").alias("a")).distinct()
        first = open_.join(waiting, "a", "left_anti")
        got = durable(first.groupBy("b").agg(F.min("a").alias("center")), "taken")
        taken.append(got)
        gone, centers = got.select("b"), first.select("a").distinct()
        left = open_.join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti").join(centers, "a", "left_anti")
        open_ = durable(left.select("a", "b"), "pairs")
    if not taken:
        return pairs.select(F.col("id2").alias("id"), F.col("id1").alias("center")).limit(0)
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.select(F.col("b.id").alias("id"), F.col("center.id").alias("center"))


def model_decisions(members: DataFrame, provider: Callable[[], Provider]) -> DataFrame:
    """``(center, merge_decision, canonical_name, confidence)`` by a model's answer for each group of ``members`` (``center`` and entity columns).

    One call a group, one provider a partition; an answer that fails or is no object gives no row.
    """
    line = F.concat(F.lit("- ["), "id", F.lit("] "), F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("entity_type", F.lit("")), F.lit("): "), F.coalesce("context", F.lit("")))
    asked = members.groupBy("center").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line"), F.col("name").alias("name")))).alias("rows"))
    asked = asked.select("center", F.array_join("rows.line", "\n").alias("prompt"), F.filter("rows.name", lambda n: n.isNotNull()).alias("names"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for batch in batches:
            out = []
            for center, prompt, names in zip(batch["center"], batch["prompt"], batch["names"], strict=True):
                try:
                    answer = model.generate_json(prompt, {"task": "coreference", "names": list(names)})
                except (ValueError, KeyError, OSError):
                    continue
                if isinstance(answer, dict):
                    out.append((center, bool(answer.get("merge", answer.get("merge_decision", True))), answer.get("canonical_name"), answer.get("confidence")))
            yield pd.DataFrame(out, columns=["center", "merge_decision", "canonical_name", "confidence"]).astype({"confidence": "Float64", "merge_decision": "boolean"})

    return asked.mapInPandas(run, "center string, merge_decision boolean, canonical_name string, confidence double")


def _decided(nodes: DataFrame, threshold: float, measure: str, decisions: DataFrame | None, provider: Callable[[], Provider] | None) -> tuple[DataFrame, DataFrame]:
    """Grouped entities with their ``center``, and a row a group with what is decided on it."""
    stars = durable(similar_groups(nodes, threshold, measure), "groups")
    members = stars.unionByName(stars.select(F.col("center").alias("id"), "center").distinct())
    listed = nodes.join(members, "id")
    rule = listed.groupBy("center").agg(
        F.array_sort(F.collect_list("id")).alias("entity_ids"), F.max_by("name", F.struct("confidence", -F.col("ord"))).alias("canonical_name"), F.max("confidence").alias("confidence")
    )
    if decisions is None and provider is not None:
        decisions = durable(model_decisions(listed, provider), "asked")
    if decisions is not None:
        side = decisions.select("center", F.col("merge_decision").alias("__m"), F.col("canonical_name").alias("__n"), F.col("confidence").alias("__c"))
        rule = rule.join(side, "center", "left").select(
            "center", "entity_ids", F.coalesce("__n", "canonical_name").alias("canonical_name"), F.coalesce("__m", F.lit(True)).alias("merge_decision"), F.coalesce("__c", "confidence").alias("confidence")
        )
    else:
        rule = rule.withColumn("merge_decision", F.lit(True))
    return listed, durable(rule, "decisions")


def _shown(rule: DataFrame) -> DataFrame:
    return rule.select("entity_ids", "canonical_name", "merge_decision", F.lit("similar names").alias("reason"), "confidence")


def resolved_groups(kg: KG, threshold: float = THRESHOLD, measure: str = "ratio", decisions: DataFrame | None = None, provider: Callable[[], Provider] | None = None) -> DataFrame:
    """The groups of :func:`resolve`, without merging their entities."""
    return _shown(_decided(durable(kg.nodes, "nodes"), threshold, measure, decisions, provider)[1])


def resolve(kg: KG, threshold: float = THRESHOLD, measure: str = "ratio", decisions: DataFrame | None = None, repoint_relationships: bool = True, provider: Callable[[], Provider] | None = None) -> tuple[KG, DataFrame, DataFrame]:
    """(graph, groups, id map) after merging coreferent entities.

    ``groups`` has the shape ``(entity_ids, canonical_name, merge_decision, reason, confidence)``.
    By rule every group merges under its most certain name; ``decisions``
    ``(center, merge_decision, canonical_name, confidence)`` overrides that per group.
    A ``provider`` is asked once a group and its answers are such decisions; a group it fails on keeps the rule.
    A merged entity's confidence is the decision's.  Groups that are not merged
    stay apart.  Relationships follow the id map unless that is switched off.
    """
    nodes = durable(kg.nodes, "nodes")
    listed, rule = _decided(nodes, threshold, measure, decisions, provider)
    merged = listed.join(rule.where("merge_decision").select("center"), "center", "left_semi")
    whole = merge_groups(merged.select("center", *nodes.columns), ["center"])
    # The merged entity keeps its centre's id: the centre is the earliest member.
    named = whole.join(rule.select(F.col("center").alias("id"), F.col("canonical_name").alias("__n"), F.col("confidence").alias("__c")), "id")
    named = named.withColumns({"name": F.col("__n"), "confidence": F.col("__c")}).select(*nodes.columns)
    rest = nodes.join(merged.select("id"), "id", "left_anti")
    entities = durable(rest.unionByName(named), "entities")
    mapping = merged.select(F.col("id").alias("old_id"), F.col("center").alias("new_id")).unionByName(rest.select(F.col("id").alias("old_id"), F.col("id").alias("new_id")))
    mapping = durable(mapping, "id-map")
    rels = repoint(kg.rels, mapping) if repoint_relationships else kg.rels
    return replace(kg, entities=entities, relationships=rels, unique=False), _shown(rule), mapping


def resolve_group(kg: KG, ids: list[str]) -> DataFrame:
    """One explicit group merged into one entity."""
    return merge_groups(kg.nodes.where(F.col("id").isin(ids)).withColumn("__group", F.lit(1)), ["__group"])
