"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame

#: Rows that a task of :func:`dealt` gets in the mean, up to as many tasks as a shuffle can write to at once; with more, its writer gathers rows in memory.
ROWS, MOST_TASKS = 1 << 18, 200


#: Shuffle files of a finished write serve no other query: Spark removes them at once, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables settled within :func:`settled_alone`.
_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def settled(df: DataFrame, what: str) -> DataFrame:
    """Writes df below spark.checkpoint.dir and reads it back.

    Several outputs read such a table, and each plan stays as small as its own step; a lost executor costs no step before it. A temporary
    folder serves only where the session names none (tests). :func:`released` deletes it.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def released(*tables: DataFrame) -> None:
    """Deletes the files of settled tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled_alone(make: Callable[[], DataFrame], what: str) -> DataFrame:
    """Settles what ``make`` returns and releases the tables that were settled on the way, which nothing else may read."""
    token = _MADE.set([])
    try:
        out = settled(make(), what)
        *passing, _ = _MADE.get()
    finally:
        _MADE.reset(token)
    released(*passing)
    if (made := _MADE.get()) is not None:
        made.append(out)
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over all cores by a key: a small file is one task, however dear the work on each of its rows."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """df, of some ``n_rows`` rows, dealt by keys: more rows make more tasks rather than larger ones."""
    return df.repartition(min(MOST_TASKS, max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / ROWS))), *keys)
