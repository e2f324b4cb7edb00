"""Tables published together, by version: readers always see one whole version, writers swap it with one atomic rename.

``path``/<version>/<table> holds the data. The file ``path``/_current names the version that counts; it is written beside and moved over the
old one in one step, so there is no moment without a version, and a writer that fails leaves the old one. A version carries the epoch it was
made from: the same epoch again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


class Versions:
    """The versions below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict | None:
        """What counts now: version, epoch, tables; None before the first version."""
        at = self._path(f"{self.path}/{POINTER}")
        if not self._files.exists(at):
            return None
        stream = self._files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def epoch(self) -> int:
        now = self.pointer()
        return -1 if now is None or now["epoch"] is None else now["epoch"]

    def read(self, table: str, version: str | None = None) -> DataFrame | None:
        """A table of the version that counts, or of another; None if there is none."""
        now = self.pointer()
        if now is None or table not in now["tables"]:
            return None
        return self.spark.read.parquet(f"{self.path}/{version or now['version']}/{table}")

    def commit(self, tables: dict[str, DataFrame], epoch: int | None = None, least: dict[str, int] | None = None) -> bool:
        """Writes all tables as a new version and makes it count. False, and nothing changes, if the epoch is not above the last one, or a
        table has fewer rows than ``least`` says."""
        if epoch is not None and epoch <= self.epoch():
            return False
        version = f"v-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{version}/{name}")
        for name, n in (least or {}).items():
            if self.spark.read.parquet(f"{self.path}/{version}/{name}").limit(n).count() < n:
                self._files.delete(self._path(f"{self.path}/{version}"), True)
                return False
        self._point({"version": version, "epoch": epoch, "tables": sorted(tables)})
        return True

    def _point(self, to: dict) -> None:
        fresh = self._path(f"{self.path}/{POINTER}-{uuid.uuid4().hex}")
        stream = self._files.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(to).encode()))
        finally:
            stream.close()
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, self._path(f"{self.path}/{POINTER}"), over)

    def retire(self, keep: int = 2) -> list[str]:
        """Deletes all versions but the last ``keep`` (by time), never the one that counts."""
        now = (self.pointer() or {}).get("version")
        folders = [f for f in self._files.listStatus(self._path(self.path)) if f.isDirectory() and f.getPath().getName().startswith("v-")]
        old = sorted(folders, key=lambda f: -f.getModificationTime())[keep:]
        gone = [f.getPath().getName() for f in old if f.getPath().getName() != now]
        for name in gone:
            self._files.delete(self._path(f"{self.path}/{name}"), True)
        return gone
