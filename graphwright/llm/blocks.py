"""Comparing rows inside groups of any size: bounded blocks, streamed in sorted order.

``blocked_rows`` cuts every group of more than ``BLOCK`` rows into hash blocks
and sends each pair of blocks to its own place, so that no task has to hold more
than two blocks of a group, however large it is.  ``stream_blocks`` hands the
sorted rows to numpy in chunks that never split a block pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.plans.durable import durable

#: Rows of a block; a pair of blocks is compared in one go.
BLOCK = 2048
#: Blocks from which a key is refined rather than compared block by block.
DENSE = 8
#: Rows that are compared at a time (several groups together).
CHUNK = 65536


def blocked_rows(df: DataFrame, key: str, spread: str, refine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows with ``gkey, gs, gt, own`` sorted for :func:`stream_blocks`.

    ``own`` is the row's block.  Every unordered pair of rows of a key meets under
    at least one (gkey, gs, gt); pairs of one block meet under gs = gt only if
    callers compare only rows of different ``own`` where gs <> gt.

    ``refine`` turns the rows of keys of more than ``DENSE`` blocks into rows of narrower keys under which
    the same links meet; what is still large then goes by blocks.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > BLOCK)
    heavy = durable(
        sizes.select(F.col(key).alias("__key"), F.ceil(F.col("__n") / BLOCK).cast("int").alias("__blocks")), "heavy"
    )
    if refine is not None:
        dense = heavy.where(F.col("__blocks") > DENSE).select("__key")
        if not dense.isEmpty():
            light = df.join(dense, df[key] == F.col("__key"), "left_anti")
            return blocked_rows(light.unionByName(refine(df.join(dense, df[key] == F.col("__key"), "left_semi"))), key, spread)
    blocks = F.coalesce("__blocks", F.lit(1))
    rows = (
        df.join(heavy, df[key] == heavy["__key"], "left")
        .withColumn("own", F.pmod(F.xxhash64(F.col(spread), F.lit(7)), blocks).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("gs", F.least("own", "__other"))
        .withColumn("gt", F.greatest("own", "__other"))
        .withColumnRenamed(key, "gkey")
        .drop("__key", "__blocks", "__other")
    )
    return rows.repartition("gkey", "gs", "gt").sortWithinPartitions("gkey", "gs", "gt")


def _arrays(table: pa.Table) -> dict[str, np.ndarray]:
    out = {}
    for name in table.column_names:
        column = table.column(name).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
        if pa.types.is_binary(column.type):
            width = len(column[0].as_py()) if len(column) else 1
            start = column.offset
            offsets = np.frombuffer(column.buffers()[1], np.int32)[start : start + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            out[name] = data.reshape(len(column), width)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def stream_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Chunks of whole block pairs as numpy columns, with ``group`` numbering the pairs; lone rows are dropped.

    Binary columns become matrices.  Where their width differs, a column ``dims`` tells it; a key has one width,
    and a chunk is handed out width by width.
    """
    held: list[pa.RecordBatch] = []
    waiting = 0

    def ready(last: bool):
        nonlocal held, waiting
        table = pa.Table.from_batches(held)
        ids = np.stack([table.column(c).to_numpy() for c in ("gkey", "gs", "gt")])
        new = np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(axis=0)]
        group = np.cumsum(new) - 1
        end = len(group) if last else int(np.flatnonzero(new)[-1])
        held = [b for b in table.slice(end).to_batches() if b.num_rows]
        waiting = len(group) - end
        group = group[:end]
        again = np.zeros(end, bool)
        if end:
            same = group[1:] == group[:-1]
            again[1:] |= same
            again[:-1] |= same
        if again.any():
            rows, numbers = table.slice(0, end).filter(pa.array(again)), group[again]
            widths = rows.column("dims").to_numpy() if "dims" in rows.column_names else np.zeros(len(numbers), np.int64)
            for width in np.unique(widths):
                own = widths == width
                arrays = _arrays(rows.filter(pa.array(own)))
                arrays["group"] = numbers[own]
                yield arrays

    for batch in batches:
        held.append(batch)
        waiting += batch.num_rows
        if waiting >= CHUNK:
            yield from ready(False)
    if held:
        yield from ready(True)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of ``a[i]`` and ``b[i]`` in place; a class's label is its least member."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return
        low, high = np.minimum(la, lb)[open_], np.maximum(la, lb)[open_]
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
