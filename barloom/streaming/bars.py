"""Bars from ticks on a stream, and draining a stream into a table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bars import wide_order


def stream_ticks(spark: SparkSession, path: str, schema: str, pattern: str, ts: str, ticker: str, price: str, order: str) -> DataFrame:
    """Landed tick files as a stream; times are cast to instants, which a watermark needs."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    return raw.select(F.col(ts).cast("timestamp").alias("ts"), F.col(ticker).alias("ticker"), F.col(price).alias("price"), F.col(order).alias("tick_id"))


def stream_bars(ticks: DataFrame, minutes: int, watermark: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV windows; a window is emitted once, after the watermark has passed it."""
    order = wide_order(F.unix_micros("ts"), F.col("tick_id"))
    return (
        ticks.withWatermark("ts", watermark).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "ticker").agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        ).select("ticker", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", settings: dict[str, str] | None = None) -> None:
    """Drain what has landed into a parquet table and stop (daily jobs, catch-up runs); ``settings`` hold while the query starts."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
