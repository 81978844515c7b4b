"""Sharding by balanced label propagation, in DataFrame operations only.

Documents are linked when they share a group key (here: equal texts).  Every
linked document starts with a shard drawn from its id.  In each round a group's
members vote with their current shards; unsettled members ask to move to the
open shard with most of their neighbours; a shard accepts requests, whole groups
first, up to what is left of its quota; accepted documents are settled.  A group
that finds its shard full votes again among the open ones, so that only groups
larger than a quota and groups at a full shard's brim are cut.  Rounds go on until
every linked document is settled; each round settles all requests or fills a shard, so
there are at most one more than shards.  Documents without links then fill the
remaining places: row counts end at most one apart (law ``rows``).

Votes and offsets are aggregates with at most shards x cells rows; requests are
ranked in hash cells, of which a group has one per ``1 / PIECES`` of all rows, so a group
that holds a third of them is never gathered in one task.

Defined results: null text is nobody's neighbour and has size 8, crc32 0; repeated
rows, also many of one or of no ``doc_id``, are placed one by one; ties go to the shard of least seeded hash; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.plans.durable import durable
from graphwright.plans.ranking import gapless_rank
from graphwright.plans.skew import attach

SHARDS = 24
#: Hash cells of the groups; cells in all that the largest groups are cut into; and room for these in a cell's number.
CELLS, PIECES, ROOM = 512, 2048, 4096


def _pick(values: dict[int, int], key: Column, default: int = 0) -> Column:
    """values[key] as an expression; the dictionary has one entry a shard."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key), F.lit(default))


def _cell(group: Column, size: Column, total: int) -> Column:
    """Hash cell of a row: its group's cell first, then, in groups of more than total / PIECES rows, a part of it.

    Small groups lie whole in one cell; a group's parts follow its share of the rows.
    """
    parts = F.greatest(F.lit(1), F.ceil(size * PIECES / max(total, 1)))
    return (F.pmod(F.xxhash64(group), F.lit(CELLS)) * ROOM + F.pmod(F.xxhash64("__row", F.lit(3)), parts)).cast("int")


def _counts(df: DataFrame, key: str) -> dict[int, int]:
    return {r[0]: r[1] for r in df.groupBy(key).count().collect()}


def place_rows(rows: DataFrame, order: list[str], shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` and a row number ``__row`` to ``rows``, which have ``doc_id`` and ``grp`` (string; null: no links).

    ``order`` lists columns that tell rows apart inside a cell.  Row counts of the
    shards end at most one apart; cut links are kept few as described above.
    """
    rows = durable(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    total = rows.count()
    target = {j: total // shards + (j < total % shards) for j in range(shards)}
    shared = rows.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = durable(shared.withColumn("linked", F.lit(True)), "groups")
    # Linked rows carry ``label``; all others (null or unique groups) are only ballast.
    label = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int")
    marked = durable(attach(rows, shared, "grp", "n").withColumn("label", F.when(F.col("linked"), label)).drop("linked"), "marked")
    free, open_rows, settled = marked.where("label is null").drop("label"), marked.where("label is not null"), []
    quota, turn = dict(target), 0
    while not open_rows.isEmpty():
        room = {j: q for j, q in quota.items() if q > 0}
        # A vote counts where the voter's shard is open; groups without such a vote draw an open shard.
        places = F.array(*[F.lit(j) for j in sorted(room)])
        draw = F.element_at(places, (F.pmod(F.xxhash64("grp", F.lit(turn)), F.lit(len(room))) + 1).cast("int"))
        votes = open_rows.unionByName(settled[-1]) if settled else open_rows
        weight = F.when(F.array_contains(places, F.col("label")), F.col("count")).otherwise(0)
        best = (
            votes.groupBy("grp", "label").count()
            .groupBy("grp").agg(F.max(F.struct(weight.alias("w"), F.xxhash64("grp", "label").alias("h"), "label")).alias("best"), F.sum("count").alias("n"))
            .select("grp", "n", F.when(F.col("best.w") > 0, F.col("best.label")).otherwise(draw).alias("want"))
        )
        best = durable(best.withColumn("__size", F.col("n")), "best")
        asked = attach(open_rows, best, "grp", "n").withColumn("__cell", _cell(F.col("grp"), F.col("__size"), total)).drop("__size")
        ranked = gapless_rank(asked, ["want"], "__cell", ["grp", *order], "__rank")
        ranked = durable(ranked.withColumn("__in", F.col("__rank") < _pick(room, F.col("want"))), "asked")
        moved = ranked.where("__in").withColumn("label", F.col("want")).select(*marked.columns)
        settled.append(moved if not settled else settled[-1].unionByName(moved))
        open_rows = ranked.where("not __in").select(*marked.columns)
        for j, n in _counts(ranked.where("__in"), "want").items():
            quota[j] -= n
        turn += 1
    rest = free.withColumn("__cell", F.pmod(F.xxhash64("__row"), F.lit(PIECES)).cast("int")).withColumn("__all", F.lit(0))
    rest = gapless_rank(rest, ["__all"], "__cell", order, "__rank")
    upto, ends = 0, []
    for j in range(shards):
        upto += quota[j]
        ends.append((upto, j))
    shard = F.when(F.col("__rank") < ends[0][0], F.lit(0))
    for upto, j in ends[1:]:
        shard = shard.when(F.col("__rank") < upto, F.lit(j))
    placed = rest.withColumn("shard", shard.cast("int")).select(*rows.columns, "shard")
    if settled:
        placed = placed.unionByName(settled[-1].withColumnRenamed("label", "shard").select(*rows.columns, "shard"))
    return placed


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.md5(F.col("text").cast("binary")).alias("grp"),
    )
    order = ["doc_id", "text_crc32", "size"]
    placed = durable(place_rows(rows, order, shards).drop("grp"), "placed")
    placed = placed.withColumn("__cell", F.pmod(F.xxhash64("__row", F.lit(5)), F.lit(CELLS)).cast("int"))
    return gapless_rank(placed, ["shard"], "__cell", order, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
