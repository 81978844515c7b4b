"""Helpers for Arrow-batched executor code: whole texts as bytes, small output batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphwright.plans.spread import spread

#: Rows handled at a time; texts are kilobytes long, so that what is made of them stays at some megabytes.
ROWS_PER_BATCH = 500
#: Bytes after which a batch is closed early, for runs of very long texts.
BYTES_PER_BATCH = 16 << 20


def map_small(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded rows and bytes; small inputs are dealt to all cores.

    Spark reads the size of its batches when a plan runs, which for a returned frame is the caller's time.  So
    the session's two limits are lowered here where they are higher (they change memory, never results), and
    are never raised.  Slices of longer batches, as a caller may set them later, cost no copy.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        now = conf.get(f"spark.sql.execution.arrow.{name}")
        digits = now.rstrip("bB")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                yield batch.slice(at, ROWS_PER_BATCH)

    return spread(df).mapInArrow(lambda batches: run(sliced(batches)), schema)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of every value, null as empty, without decoding."""
    for value in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()):
        yield value.as_py() or b""


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one uint8 array and the n + 1 offsets of its rows (null: empty)."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]
