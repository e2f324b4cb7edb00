"""Streams: new listing files screened batch by batch, and duplicates dropped by fingerprint within a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gazette.functions.keys import fingerprint
from gazette.sources.versions import Versions


def listing_stream(spark: SparkSession, path: str, schema: str, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def screen_stream(listings: DataFrame, apply: Callable[[DataFrame, str], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to ``apply`` with a run id that is the same when the batch is replayed; stops when nothing is left."""
    return listings.writeStream.foreachBatch(lambda batch, epoch: apply(batch, f"run-{epoch}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def screen_versions(batch: DataFrame, epoch: int, versions: Versions, apply: Callable[[DataFrame, dict[str, DataFrame | None], str], dict[str, DataFrame]], tables: tuple[str, ...]) -> bool:
    """Screens one micro-batch over the last version and commits the next: ``apply(batch, tables before, run id)`` returns the tables after.

    All tables of a version change together. An epoch that was committed before, and is replayed after a failure, changes nothing.
    """
    if epoch <= versions.epoch():
        return False
    return versions.commit(apply(batch, {t: versions.read(t) for t in tables}, f"run-{epoch}"), epoch)


def screen_into(listings: DataFrame, versions: Versions, apply: Callable[[DataFrame, dict[str, DataFrame | None], str], dict[str, DataFrame]], tables: tuple[str, ...], checkpoint: str) -> StreamingQuery:
    """A stream of listings into versions, one for each micro-batch; stops when nothing is left."""
    return listings.writeStream.foreachBatch(lambda batch, epoch: screen_versions(batch, epoch, versions, apply, tables)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(listings: DataFrame, seen_at: str, delay: str = "1 day") -> DataFrame:
    """The first row of each fingerprint; state older than the delay is dropped."""
    key = fingerprint(F.col("source"), F.col("tender_number"), F.col("tender_page_url"), F.col("tender_title"), F.col("issuing_authority"))
    return listings.withColumn("fingerprint", key).withWatermark(seen_at, delay).dropDuplicatesWithinWatermark(["fingerprint"])
