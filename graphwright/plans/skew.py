"""Left join of rows with facts about their key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.plans.durable import durable

#: A key is hot if it has more than this share of the rows; there are fewer than 1 / HOT such keys.
HOT = 1e-3


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one row a key) on ``key``; ``weight`` is the key's number of rows.

    Both inputs should be materialised.  Facts of hot keys are broadcast: there are
    fewer than a thousand of them whatever the size of the data, because each has
    over a thousandth of all rows.  The other keys join by a shuffle, in which no
    key is large.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    side = facts.withColumnRenamed(key, "__key")
    hot = F.broadcast(side.where(F.col(weight) > HOT * total))
    spread = rows[key] == F.col("__key")
    warm = rows.join(hot, spread, "inner").drop("__key", weight)
    cold = rows.join(hot.select("__key"), spread, "left_anti")
    cold = cold.join(side.where(F.col(weight) <= HOT * total), cold[key] == F.col("__key"), "left").drop("__key", weight)
    return warm.unionByName(cold)


#: Rows of one key that :func:`salted` lets meet in one place.
PER_SALT = 2048


def salted(rows: DataFrame, facts: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` inner-joined with ``facts`` (one row a key, of any width) on ``key``.

    A key of more than ``PER_SALT`` rows is cut by the hash of ``spread``, and its one
    fact is sent to each part, so that the copies stay a small share of the rows and
    no task holds a large key.  ``rows`` should be materialised.
    """
    heavy = rows.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PER_SALT)
    heavy = durable(heavy.select("__key", F.ceil(F.col("__n") / PER_SALT).cast("int").alias("__parts")), "heavy")
    if heavy.isEmpty():
        return rows.join(facts, key)
    # Fewer than rows / PER_SALT keys are heavy; the planner broadcasts them where their written size allows it.
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(heavy, rows[key] == F.col("__key"), "left").withColumn("__salt", F.pmod(F.xxhash64(F.col(spread), F.lit(5)), parts).cast("int"))
    right = facts.join(heavy, facts[key] == F.col("__key"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("__key", "__parts").join(right.drop("__key", "__parts"), [key, "__salt"]).drop("__salt")
