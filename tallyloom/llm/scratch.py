"""Intermediate tables in the folder that all executors share.

A table written here cuts the lineage: if an executor is lost, later stages read the files again
instead of computing them anew.  Each application writes to a folder of its own below the one that
``spark.checkpoint.dir`` names, which goes when the application ends or calls ``discard``.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans.folders import shared_root

#: Rows that tasks hand to Python at once while such tables are written: rows with whole texts are large.
ARROW_ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Bytes of the tables that a result is made of for each task that writes it, if they are named.
TASK_BYTES = 4 << 20
_ROOTS: dict[str, str] = {}
_LOCK = Lock()
#: Writers at work, and the setting before the first of them.
_writers: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """This application's folder, without a slash at its end."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        if app not in _ROOTS:
            _ROOTS[app] = f"{shared_root(spark)}/tallyloom-{app}-{uuid.uuid4().hex[:8]}"
            path, fs = _hadoop(spark, _ROOTS[app])
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        return _ROOTS[app]


def _hadoop(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _small_batches(spark: SparkSession):
    """Small Arrow batches while any table is written; the setting comes back with the last writer."""
    was = spark.conf.get(ARROW_ROWS)
    with _LOCK:
        _writers.append(_writers[0] if _writers else was)
        spark.conf.set(ARROW_ROWS, str(min(int(_writers[0]), BATCH)) if int(_writers[0]) > 0 else str(BATCH))
    try:
        yield
    finally:
        with _LOCK:
            was = _writers.pop()
            if not _writers:
                spark.conf.set(ARROW_ROWS, was)


def written_bytes(*tables: DataFrame) -> int:
    """Bytes of the files that tables returned by stash read."""
    total = 0
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            path, fs = _hadoop(t.sparkSession, folder)
            total += fs.getContentSummary(path).getLength()
    return total


def stash(df: DataFrame, label: str, *made_of: DataFrame) -> DataFrame:
    """Write df as Parquet below the shared folder and return the table read back (its size is then known to the planner).

    Adaptive execution sizes the files: what comes out of a shuffle has as many as its bytes ask for.  made_of: written tables
    that df is not much larger than; the last stage then has a task for every TASK_BYTES of them at most, so a
    small result is not written as a file for each partition of a shuffle, and a large one has tasks in proportion.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if made_of:
        df = df.coalesce(1 + written_bytes(*made_of) // TASK_BYTES)
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Delete all tables that this application has written here; tables of others stay."""
    with _LOCK:
        at = _ROOTS.pop(spark.sparkContext.applicationId, None)
    if at:
        path, fs = _hadoop(spark, at)
        fs.delete(path, True)
