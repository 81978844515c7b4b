"""Durable intermediates: lineage is cut by writing a table to the cluster's shared folder.

Executors can be lost at any time, so nothing here relies on blocks that only
one executor holds.  A written parquet table also gives the planner a measured
size, which is what decides whether a later join may broadcast it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediates: ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary one; on a cluster
    this raises, as each executor would write to a disk of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="graphwright-")
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may already be gone at exit
            pass

    atexit.register(remove)


def durable(df: DataFrame, tag: str = "t", replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as parquet below the shared folder and read it back.

    ``replaces`` is an earlier result that nothing needs once this one is written; its files are deleted,
    so that a loop holds one round and not all.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphwright/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _remove_at_exit(spark, path)
    if replaces is not None:
        release(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a :func:`durable` result that nothing needs any more; other frames are left alone."""
    path = getattr(df, "_durable_path", None)
    if path:
        _remove(df.sparkSession, path)
