"""Session settings shared by jobs, tests and the benchmark, and the shared scratch folder."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "12g", scratch: str = "/tmp/barloom-checkpoints") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", scratch)
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The context's own checkpoint folder comes first, then the setting ``spark.checkpoint.dir``. Only where neither is
    set, a folder in the warehouse (which a cluster shares as well) is set for the session.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
    return context.getCheckpointDir()


class Scratch:
    """Tables of one run in the shared folder; ``drop`` removes one, ``close`` (or leaving the ``with``) all of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/barloom-{uuid.uuid4().hex}"
        self._n = 0

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def path(self) -> str:
        """A new name in the folder."""
        self._n += 1
        return f"{self.folder}/{self._n}"

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a table once and read it back: it outlives executors and is computed once however many plans use it."""
        path = self.path()
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        """Remove a kept table that no plan needs any more."""
        self._delete(df._scratch_path)

    def close(self) -> None:
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the session's scratch folder; ``release`` removes all that a session has settled."""
    return session_scratch(df.sparkSession).keep(df)


_OPEN: dict[str, Scratch] = {}


def session_scratch(spark: SparkSession) -> Scratch:
    """The scratch folder of this application."""
    return _OPEN.setdefault(spark.sparkContext.applicationId, Scratch(spark))


def release(spark: SparkSession) -> None:
    """Remove every table that ``settle`` has written for this application; their readers must be done."""
    scratch = _OPEN.pop(spark.sparkContext.applicationId, None)
    if scratch is not None:
        scratch.close()
