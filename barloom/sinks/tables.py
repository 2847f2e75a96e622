"""Stored tables: ledgers, symbol-month bars, scan tables, fingerprints, outcomes, caches, watchlists."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import clean_symbol, half_even


def write_csv(df: DataFrame, path: str, decimals: int = 6) -> None:
    """CSV with a fixed number of decimals and lists joined by a pipe."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.format_string(f"%.{decimals}f", c)
            c = F.when(F.col(f"`{f.name}`").isNotNull(), c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        cols.append(c.alias(f.name))
    df.select(*cols).write.mode("errorifexists").option("header", True).csv(path)


def write_symbol_months(bars: DataFrame, path: str) -> None:
    """Bars partitioned by month and symbol, one sorted file per partition and task."""
    parts = bars.withColumn("effective_month", F.date_format("ts", "yyyy-MM")).withColumnRenamed("ticker", "symbol")
    (parts.repartition("effective_month", "symbol").sortWithinPartitions("effective_month", "symbol", "ts")
     .write.mode("append").partitionBy("effective_month", "symbol").parquet(path))


def symbol_month_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("effective_month", "symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end")
    )


def write_snapshot(flagged: DataFrame, quality: DataFrame, audit: DataFrame, path: str) -> None:
    """Cleaned bars, removed rows with their reasons, per-ticker quality and the audit row."""
    passing = quality.filter("status = 'pass'").select("ticker")
    good = flagged.filter(F.size("reason_codes") == 0).drop("reason_codes").join(passing, "ticker", "left_semi")
    good.write.parquet(f"{path}/bars")
    flagged.filter(F.size("reason_codes") > 0).write.parquet(f"{path}/removed")
    quality.write.parquet(f"{path}/quality")
    audit.write.parquet(f"{path}/audit")


def append_scan(root: str, session: DataFrame, observations: DataFrame, signals: DataFrame, run: DataFrame) -> None:
    """Append one scan to its four tables; a session id seen before is an error."""
    spark = session.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/scan_sessions")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    old = spark.read.parquet(f"{root}/scan_sessions").select("session_id") if there else None  # the first scan creates the table
    if old is not None and session.join(old, "session_id", "left_semi").limit(1).count():
        raise ValueError("scan session id already stored")
    # the session row goes last: readers join on it, so a half-written scan stays invisible
    observations.write.mode("append").parquet(f"{root}/scan_observations")
    signals.write.mode("append").parquet(f"{root}/signal_history")
    run.write.mode("append").parquet(f"{root}/scan_runs")
    session.write.mode("append").parquet(f"{root}/scan_sessions")


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows merged, the newest per key; written to a new version by the caller."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def mark_outcomes(outcomes: DataFrame, path: str, provider: str) -> None:
    """Append resolved outcomes; signals are joined with them on read."""
    (outcomes.filter("outcome_close IS NOT NULL").select(
        "id", half_even(F.col("outcome_close"), 4).alias("outcome_close"), half_even(F.col("outcome_pct"), 2).alias("outcome_pct"),
        F.lit(provider).alias("outcome_provider"), F.current_timestamp().alias("marked_at"),
    ).write.mode("append").parquet(path))


def fresh_earnings(cache: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Newest cached date per (ticker, source) not older than ``hours``; unknown dates are never cached."""
    now = F.lit(as_of).cast("timestamp")
    live = cache.filter(F.col("next_earnings").isNotNull() & (F.col("fetched_at") > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("fetched_at") <= now))
    return live.groupBy("ticker", "source").agg(F.max(F.struct("fetched_at", "next_earnings")).alias("r")).select("ticker", "source", "r.next_earnings", "r.fetched_at")


def save_watchlist(members: DataFrame, name: str, tickers: DataFrame, now: str) -> DataFrame:
    """Members with list ``name`` replaced by cleaned tickers (``ticker``, ``pos``); its creation time is kept."""
    t = F.lit(now).cast("timestamp")
    created = members.filter(F.col("name") == name).agg(F.min("created_at").alias("_c"))
    fresh = tickers.withColumn("ticker", clean_symbol(F.col("ticker"))).filter("ticker IS NOT NULL").groupBy("ticker").agg(F.min("pos").alias("pos"))
    rows = fresh.crossJoin(F.broadcast(created)).select(
        F.lit(name).alias("name"), "ticker", F.col("pos").cast("int").alias("pos"), F.coalesce("_c", t).alias("created_at"), t.alias("updated_at")
    )
    return members.filter(F.col("name") != name).unionByName(rows)


def load_watchlist(members: DataFrame, name: str) -> DataFrame:
    return members.filter(F.col("name") == name).orderBy("pos").select("ticker")


def list_watchlists(members: DataFrame) -> DataFrame:
    return members.groupBy("name").agg(F.count(F.lit(1)).alias("tickers"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")).orderBy("name")
