"""Snapshots of the store as committed versions: one writer at a time, readers see whole versions only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.config import EngineConfig
from loamstone.operators.mutate import Snapshot

TABLES = {
    "records": "id string, content string, timestamp string, timestamp_epoch double, owner_id string, local_id string, agent_name string, session_id string, turn_id string, "
    "importance double, access_count bigint, parent_id string, embedding array<float>, expires_at double",
    "documents": "id string, content string, timestamp string, timestamp_epoch double, owner_id string, local_id string, agent_name string, session_id string, turn_id string, "
    "chunk_count int, chunk_ids array<string>, expires_at double",
    "guards": "guard_key string, record_id string, expires_at double",
}


class Outdated(RuntimeError):
    """Another writer has committed since the snapshot was read."""


class SnapshotStore:
    """Versions under a folder that all executors reach.

    The tables of a version are written first, to a folder of their own. The version exists once its
    number is created under ``commits``, which only one writer can do; a writer that comes second, or
    that failed before, leaves nothing that a reader sees. The file system must create files exclusively.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((path, *parts)))
        self._system = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._system.exists(self._at("commits")):
            return []
        return sorted(int(x.getPath().getName()) for x in self._system.listStatus(self._at("commits")) if x.getPath().getName().isdigit())

    def _folder(self, version: int) -> str:
        stream = self._system.open(self._at("commits", str(version)))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> tuple[Snapshot, int]:
        """A version (the latest, if none is named) and its number; 0 and empty tables before the first.

        Columns that a version doesn't have are NULL, so older versions stay readable.
        """
        held = self.versions()
        number = version if version is not None else held[-1] if held else 0
        if number == 0:
            return Snapshot(*(self.spark.createDataFrame([], schema) for schema in TABLES.values())), 0
        folder = self._folder(number)
        return Snapshot(*(self._table(folder, name) for name in TABLES)), number

    def _table(self, folder: str, name: str) -> DataFrame:
        held = self.spark.read.parquet(f"{self.path}/{folder}/{name}")
        wanted = self.spark.createDataFrame([], TABLES[name]).schema
        return held.select(*(F.col(f.name).cast(f.dataType) if f.name in held.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))

    def commit(self, snapshot: Snapshot, based_on: int, cfg: EngineConfig | None = None) -> int:
        """Write ``snapshot`` as the version after ``based_on``; ``Outdated`` if that exists already.

        With ``cfg``, vectors of another dimension than its are refused.
        """
        if self.versions()[-1:] not in ([], [based_on]):
            raise Outdated(f"version {based_on} is not the latest")
        folder = f"version-{based_on + 1}-{uuid.uuid4().hex}"
        try:
            for name in TABLES:
                rows = getattr(snapshot, name)
                rows.select(*(f.name for f in self.spark.createDataFrame([], TABLES[name]).schema if f.name in rows.columns)).write.parquet(f"{self.path}/{folder}/{name}")
            if cfg is not None:
                odd = self._table(folder, "records").where(F.col("embedding").isNotNull() & (F.size("embedding") != cfg.embedding_dim))
                if not odd.isEmpty():
                    raise ValueError(f"a vector has not {cfg.embedding_dim} places")
            try:
                stream = self._system.create(self._at("commits", str(based_on + 1)), False)
            except Exception as e:  # the file system's own error: it exists
                raise Outdated(f"version {based_on + 1} was committed by another writer") from e
            stream.writeUTF(folder)
            stream.close()
        except BaseException:
            self._system.delete(self._at(folder), True)
            raise
        return based_on + 1

    def clean(self, keep: int = 2) -> None:
        """Remove the tables of all but the latest ``keep`` versions."""
        for version in self.versions()[:-keep]:
            self._system.delete(self._at(self._folder(version)), True)
            self._system.delete(self._at("commits", str(version)), False)
