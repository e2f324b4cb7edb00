"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None:
        named = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Shuffle files of a finished write serve no other query: with the first setting Spark removes them at once, not when the driver collects
#: garbage. The second bounds what a Python worker holds of long rows.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored DataFrame that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_where(docs: DataFrame, text_col: str, marks: Callable) -> DataFrame:
    """The rows of docs, with all their columns, that ``marks`` keeps; it yields (first row, boolean array) for chunks of a text column."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, kept in marks(batch.column(at)):
                yield batch.slice(first, len(kept)).filter(pa.array(kept))

    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # any name is allowed in docs
    return plain.mapInArrow(run, plain.schema).toDF(*names)
