"""Using all cores on inputs that are a file or two."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes a core below which an input is dealt out anew; larger ones have enough splits of their own.
BYTES_PER_CORE = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is known to be small, else unchanged.

    A small table is often one row group, which one task reads however many cores
    wait.  The size is the planner's estimate; nothing runs to find it, and the
    shuffle is bounded by ``BYTES_PER_CORE`` times the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < size <= BYTES_PER_CORE * cores else df
