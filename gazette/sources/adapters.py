"""Sources of listings as plug-ins: each knows how to read its listings; all are read into one table, and one that fails doesn't stop the others."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gazette.sources.io import evolved


class Adapter(Protocol):
    """A source. ``read_listings`` returns its listings with as many of the listing columns as it has."""

    name: str

    def read_listings(self, spark: SparkSession) -> DataFrame: ...


@dataclass
class FileAdapter:
    """Listings that another process leaves as files."""

    name: str
    path: str
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)

    def read_listings(self, spark: SparkSession) -> DataFrame:
        return spark.read.options(**self.options).format(self.format).load(self.path)


def read_all(spark: SparkSession, adapters: list[Adapter], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(listings, errors): the listings of all sources in ``schema``, with ``source`` set, and (source, error) of those that can't be read."""
    out, errors = spark.createDataFrame([], schema), []
    for adapter in adapters:
        try:
            own = evolved(adapter.read_listings(spark).drop("source"), T.StructType([f for f in schema if f.name != "source"]))
        except Exception as error:  # a source that is down or has changed
            errors.append((adapter.name, f"{type(error).__name__}: {error}".splitlines()[0][:300]))
            continue
        own = own.selectExpr(*(f"'{adapter.name}' as source" if c == "source" else f"`{c}`" for c in schema.names))
        out = out.unionByName(own)
    return out, spark.createDataFrame(errors, "source string, error string")
