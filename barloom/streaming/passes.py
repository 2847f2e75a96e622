"""Scheduled passes over what has landed, on trading days only, each batch exactly once."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import at_local, local_day

# Local minutes of the day at which the passes are due.
DUE = {"premarket": 8 * 60, "outcomes": 16 * 60 + 30}


def trading_dates(scans: DataFrame, sessions: DataFrame, at: str = "scan_time") -> DataFrame:
    """Adds ``trading_date``: the local day of an instant, null where that day has no session."""
    days = F.broadcast(sessions.select(F.col("session_date").alias("_day"), F.lit(True).alias("_open")))  # one row a day
    joined = scans.withColumn("_day", local_day(at)).join(days, "_day", "left")
    return joined.withColumn("trading_date", F.when(F.col("_open"), F.col("_day"))).drop("_day", "_open")


def due_at(day: str, name: str):
    """The instant at which a pass is due on a local day."""
    return at_local(F.col(day), F.lit(DUE[name]))


def run_pass(stream: DataFrame, sessions: DataFrame, scan: Callable[[DataFrame], DataFrame], root: str, query_id: str, checkpoint: str, name: str = "outcomes") -> None:
    """Drain what has landed (``ts``) through ``scan``, day by day, and stop.

    A batch writes its results and then its ledger rows, one per local day, each into the folder of (query id, batch id): a batch that is run
    again after a loss overwrites itself, a drained stream has no batch left. On closed days nothing is scanned; the ledger row has a null
    trading date. ``results`` joined with ``ledger`` are what has been committed: see ``committed``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        where = f"query_id={query_id}/batch_id={batch_id}"
        days = batch.withColumn("scan_date", local_day("ts")).withColumn("scan_time", due_at("scan_date", name))
        dated = trading_dates(days, sessions)
        scan(dated.filter("trading_date IS NOT NULL")).write.mode("overwrite").parquet(f"{root}/results/{where}")
        ledger = dated.groupBy("scan_date", "scan_time", "trading_date").agg(F.count(F.lit(1)).alias("landed_rows"))
        ledger.withColumn("status", F.when(F.col("trading_date").isNull(), "skipped_closed").otherwise("scanned")).write.mode("overwrite").parquet(f"{root}/ledger/{where}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def committed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``ledger`` and the results of its batches; results of a batch that did not reach its ledger stay out."""
    ledger = spark.read.parquet(f"{root}/ledger")
    results = spark.read.parquet(f"{root}/results")
    keys = ["query_id", "batch_id"]
    return ledger, results.join(ledger.select(*keys).distinct(), keys, "left_semi")
