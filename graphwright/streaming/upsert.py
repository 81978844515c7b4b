"""Incremental graph building from a stream: windowed activity and exactly-once upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphwright.operators.graph import latest


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Edges user -> event type per window with their weight, from a stream of ``(ts, user_id, event_type, value)``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", window).alias("w"), "user_id", "event_type")
    edges = grouped.agg(F.count(F.lit(1)).alias("weight"), F.sum("value").alias("value"))
    return edges.select(F.col("w.start").alias("window_start"), F.concat(F.lit("u"), "user_id").alias("source_entity"), F.col("event_type").alias("target_entity"), "weight", "value")


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    """Append micro-batches of entities or relationships under ``path``; each batch writes its own folder.

    A batch that is repeated after a failure overwrites its folder, so every row
    lands once; :func:`current` gives the last row of each key.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = latest(batch, keys or ["id"], ["ord"]).withColumn("__batch", F.lit(number))
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def current(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The last row of every key of a table that :func:`upsert_stream` wrote."""
    return latest(rows, keys or ["id"], ["__batch", "ord"]).drop("__batch", "batch")
