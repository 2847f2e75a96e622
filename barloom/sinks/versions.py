"""Versioned tables: a new folder per version, a manifest of its files, a pointer that is set last."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landed import folder_path, hashed_files, present_files, relative
from .tables import upsert_latest


class VersionConflict(ValueError):
    """Another writer has committed the version that this one was to become."""


class VersionedTables:
    """Named tables that are committed together under one root.

    A commit writes all tables into a fresh folder, then a manifest with rows and hash of every file, then creates the pointer of the next
    version. Creating a pointer that exists fails, so of two writers one wins; a writer that dies before leaves the last version as it was.
    Readers resolve the pointer once and stay on that version's folder.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def current(self) -> int:
        """The newest committed version; 0 before the first."""
        fs, path = self._fs()
        where = path(f"{self.root}/pointers")
        return max((int(s.getPath().getName()) for s in fs.listStatus(where)), default=0) if fs.exists(where) else 0

    def folder(self, version: int) -> str:
        """The folder of a committed version."""
        fs, path = self._fs()
        stream = fs.open(path(f"{self.root}/pointers/{version:012d}"))
        try:
            return f"{self.root}/data/{stream.readUTF()}"
        finally:
            stream.close()

    def stage(self, tables: dict[str, DataFrame]) -> str:
        """Writes tables and manifest of a version to be; nobody reads them before ``publish``."""
        name = uuid.uuid4().hex
        where = f"{self.root}/data/{name}"
        for table, df in tables.items():
            df.write.parquet(f"{where}/{table}")
        counted = None
        for table in tables:
            rows = self.spark.read.parquet(f"{where}/{table}").groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("rows"))
            rows = rows.select(relative("_path", folder_path(self.spark, where)).alias("relative_path"), "rows")
            counted = rows if counted is None else counted.unionByName(rows)
        files = present_files(self.spark, where, "*.parquet").join(counted, "relative_path", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
        hashed_files(files, where).write.parquet(f"{self.root}/manifests/{name}")
        return name

    def publish(self, name: str, after: int) -> int:
        """Makes a staged version the one after ``after``."""
        fs, path = self._fs()
        where = path(f"{self.root}/pointers/{after + 1:012d}")
        if fs.exists(where):
            raise VersionConflict(f"version {after + 1} has been committed by another writer")
        try:
            stream = fs.create(where, False)
        except Exception as taken:
            raise VersionConflict(f"version {after + 1} has been committed by another writer") from taken
        stream.writeUTF(name)
        stream.close()
        return after + 1

    def commit(self, tables: dict[str, DataFrame], after: int | None = None) -> int:
        """Writes and publishes the version after ``after`` (by default the current one when the call starts)."""
        after = self.current() if after is None else after
        return self.publish(self.stage(tables), after)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table of a version, by default the current one; later commits do not change what is read."""
        return self.spark.read.parquet(f"{self.folder(version or self.current())}/{table}")

    def manifest(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/manifests/{self.folder(version or self.current()).rsplit('/', 1)[1]}")

    def faults(self, version: int | None = None) -> DataFrame:
        """Files of a version that are missing or whose hash has changed."""
        version = version or self.current()
        found = hashed_files(self.manifest(version).select("relative_path", F.col("sha256").alias("expected_sha256")), self.folder(version))
        return found.filter(~F.col("sha256").eqNullSafe(F.col("expected_sha256"))).withColumn("verdict", F.when(F.col("sha256").isNull(), "missing_file").otherwise("hash_mismatch"))

    def upsert(self, table: str, new: DataFrame, keys: list[str], order: str) -> int:
        """The current table with ``new`` merged in, the newest row per key, as the next version."""
        now = self.current()
        return self.commit({table: upsert_latest(self.read(table, now), new, keys, order) if now else new}, now)


def commit_snapshot(tables: VersionedTables, flagged: DataFrame, quality: DataFrame, audit: DataFrame) -> int:
    """Cleaned bars, removed rows with their reasons, per-ticker quality and the audit row as one version."""
    passing = quality.filter("status = 'pass'").select("ticker")
    clean = F.size("reason_codes") == 0
    return tables.commit({
        "bars": flagged.filter(clean).drop("reason_codes").join(passing, "ticker", "left_semi"), "removed": flagged.filter(~clean), "quality": quality, "audit": audit,
    })


def put_earnings(tables: VersionedTables, fetched: DataFrame) -> int:
    """Fetched dates into the cache (ticker, source, next_earnings, fetched_at); unknown dates are never cached."""
    return tables.upsert("earnings", fetched.filter("next_earnings IS NOT NULL"), ["ticker", "source"], "fetched_at")
