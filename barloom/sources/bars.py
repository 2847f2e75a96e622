"""Bar sources: landed files and adapters from trade-like tables."""
from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import CANDLES


def ticks_to_bars(ticks: DataFrame, group: list[str], order: Column) -> DataFrame:
    """OHLCV of ticks (``price``, ``quantity``) per group; ``order`` is one sortable number.

    A numeric order key keeps ``min_by``/``max_by`` on hash aggregation, so ticks combine map-side
    and a hot ticker reaches the shuffle as one row per group and task.
    """
    t = ticks.withColumn("_order", order)
    return t.groupBy(*group).agg(
        F.min_by("price", "_order").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "_order").alias("close"),
        F.sum("quantity").alias("volume"),
    )


def wide_order(first: Column, second: Column) -> Column:
    """Two longs, the second after the first, as one whole number of up to 38 digits: exact for ``first`` below 2**56 in magnitude."""
    return first.cast("decimal(17,0)") * F.lit(Decimal(2**64)) + (second.cast("decimal(20,0)") + F.lit(Decimal(2**63)))


def _line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    return (
        li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("p_brand").alias("ticker"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("quantity"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        )
    )


def _line_order() -> Column:
    """(orderkey, linenumber, parts) as one number, so that the aggregation buffer stays mutable.

    Exact up to 2**23 lines of an order and 2**40 parts times suppliers' spread; lines of one order and number go by part and supplier.
    """
    rest = F.col("l_linenumber").cast("bigint") * 2**40 + F.col("l_partkey") * 31 + F.col("l_suppkey")
    return wide_order(F.col("l_orderkey"), rest)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of part brands: unit price and quantity of the lines shipped on a day."""
    return ticks_to_bars(_line_ticks(spark, sf_dir), ["ticker", "ts"], _line_order())


def market_bars(spark: SparkSession, sf_dir: str, family: bool = False) -> DataFrame:
    """Daily bars of all brands together, or of brand families (the sector proxies)."""
    name = F.substring("ticker", 1, 7) if family else F.lit("MARKET")
    ticks = _line_ticks(spark, sf_dir).withColumn("ticker", name)
    return ticks_to_bars(ticks, ["ticker", "ts"], _line_order())


def event_bars(spark: SparkSession, sf_dir: str, minutes: int = 60, user_groups: int = 1) -> DataFrame:
    """Intraday bars of event types (times user groups); every event is one unit of volume."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value", "user_id")
    step = minutes * 60
    t = F.col("ts").cast("timestamp")
    start = F.timestamp_seconds(F.floor(F.unix_seconds(t) / step) * step)
    ticker = F.col("event_type")
    if user_groups > 1:
        ticker = F.concat(ticker, F.lit("-"), F.col("user_id") % user_groups)
    ticks = ev.select(
        ticker.alias("ticker"), start.alias("bar_ts"), F.unix_micros(t).alias("us"),
        "event_id", F.col("value").alias("price"), F.lit(1.0).alias("quantity"),
    )
    # microseconds inside the bar, then the event id
    order = wide_order(F.col("us") - F.unix_micros("bar_ts"), F.col("event_id"))
    return ticks_to_bars(ticks, ["ticker", "bar_ts"], order).withColumnRenamed("bar_ts", "ts")


def read_csv_bars(spark: SparkSession, path: str, zone: str | None = None) -> DataFrame:
    """CSV bars with a ``datetime`` or ``date`` column; naive times need an explicit zone."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in raw.columns}
    time = [F.col(names[c]) for c in ("datetime", "date") if c in names]
    if not time:
        raise ValueError("CSV bars need a datetime or date column")
    missing = [c for c in ("open", "high", "low", "close", "volume") if c not in names]
    if missing:
        raise ValueError(f"CSV bars lack columns {missing}")
    text = F.coalesce(*time)
    aware = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & text.rlike(":")
    local = F.try_to_timestamp(text)
    ts = F.when(aware, local).otherwise(F.to_utc_timestamp(local, zone) if zone else F.lit(None).cast("timestamp"))
    prices = [F.col(names[c]).try_cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    ticker = F.col(names["ticker"]) if "ticker" in names else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return raw.select(ticker.alias("ticker"), ts.alias("ts"), *prices)


def read_parquet_months(spark: SparkSession, path: str, eligible: DataFrame | None = None) -> DataFrame:
    """Symbol-month bars; with ``eligible`` (effective_month, symbol) other partitions are pruned."""
    bars = spark.read.parquet(path)
    return bars if eligible is None else bars.join(eligible, ["effective_month", "symbol"], "left_semi")


def normalize_candles(raw: DataFrame) -> DataFrame:
    """Landed candle payloads (``ticker``, ``payload`` JSON) to bars: epoch-ms time, keep the last duplicate."""
    parsed = raw.select("ticker", F.posexplode(F.from_json("payload", CANDLES)["candles"]).alias("arrival", "c"))
    return keep_one(
        parsed.select(
            "ticker",
            F.timestamp_millis(F.col("c.datetime").try_cast("bigint")).alias("ts"),
            *[F.col(f"c.{n}").try_cast("double").alias(n) for n in ("open", "high", "low", "close", "volume")],
            "arrival",
        ).filter(F.col("ts").isNotNull()),
        ["ticker", "ts"], "arrival", last=True,
    ).drop("arrival")


def keep_one(df: DataFrame, keys: list[str], order: str, last: bool) -> DataFrame:
    """One row per key: the last or first by ``order``, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def daily_history(bars: DataFrame, start: str, end: str, order: str | None = None) -> DataFrame:
    """Bars within [start, end], one per (ticker, ts) keeping the last; rows with only the close missing stay."""
    fields = ["open", "high", "low", "close", "volume"]
    kept = bars.filter(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    kept = kept.dropna("all", subset=fields)
    return keep_one(kept, ["ticker", "ts"], order, last=True) if order else kept


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers are NULL only: Spark orders NaN above every number."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
