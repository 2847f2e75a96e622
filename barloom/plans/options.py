"""Options activity: normalised flow and chain rows, scans, put/call balance."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import clean_flag, clean_number, clean_text
from ..schemas import FLOW_RECORD

# The two kinds of options data.
TRUE_FLOW, CHAIN_SNAPSHOT = "true_flow", "chain_snapshot"
COLUMNS = [
    "ticker", "requested_source", "actual_source", "data_kind", "type", "side", "strike", "expiry", "premium", "volume", "open_interest",
    "vol_oi_ratio", "is_sweep", "provider_sentiment", "timestamp", "last", "bid", "ask",
]


def vol_oi_ratio(volume: Column, open_interest: Column) -> Column:
    """Volume over open interest; NULL unless open interest is positive and volume is not negative."""
    return F.when((open_interest > 0) & (volume >= 0), volume / open_interest)


def contract_type(value: Column) -> Column:
    s = F.upper(clean_text(value))
    return F.when(s.isin("CALL", "C"), "CALL").when(s.isin("PUT", "P"), "PUT").otherwise(s)


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLOW_RECORD).json(path)


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("vol_oi_ratio", vol_oi_ratio(F.col("volume"), F.col("open_interest"))).select(*COLUMNS)


def normalize_flow(records: DataFrame, requested: str, actual: str) -> DataFrame:
    """Flow prints to the eighteen-column schema."""
    null_d = F.lit(None).cast("double")
    num = lambda c: clean_number(F.col(c))
    return _finish(records.select(
        "ticker", F.lit(requested).alias("requested_source"), F.lit(actual).alias("actual_source"), F.lit(TRUE_FLOW).alias("data_kind"),
        contract_type(F.col("put_call")).alias("type"), clean_text(F.col("side")).alias("side"), num("strike_price").alias("strike"),
        clean_text(F.col("expiry_date")).alias("expiry"), num("premium").alias("premium"), num("volume").alias("volume"),
        num("open_interest").alias("open_interest"), clean_flag(F.col("is_sweep")).alias("is_sweep"),
        clean_text(F.col("sentiment")).alias("provider_sentiment"), clean_text(F.col("created_at")).alias("timestamp"),
        null_d.alias("last"), null_d.alias("bid"), null_d.alias("ask"),
    ))


def normalize_chain(rows: DataFrame, requested: str, actual: str) -> DataFrame:
    """Chain snapshots of either dialect to the eighteen-column schema."""
    have = set(rows.columns)

    def pick(*names: str) -> Column:
        found = [F.col(n) for n in names if n in have]
        return found[0] if found else F.lit(None).cast("string")

    num = lambda *n: clean_number(pick(*n))
    last = num("last") if "last" in have else num("lastPrice")
    text = lambda: F.lit(None).cast("string")
    return _finish(rows.select(
        "ticker", F.lit(requested).alias("requested_source"), F.lit(actual).alias("actual_source"), F.lit(CHAIN_SNAPSHOT).alias("data_kind"),
        F.upper(pick("type", "option_type")).alias("type"), text().alias("side"), num("strike").alias("strike"),
        pick("expiry", "expiration_date").alias("expiry"), num("premium").alias("premium"), num("volume").alias("volume"),
        num("openInterest", "open_interest").alias("open_interest"), F.lit(False).alias("is_sweep"),
        text().alias("provider_sentiment"), text().alias("timestamp"), last.alias("last"), num("bid").alias("bid"), num("ask").alias("ask"),
    ))


def scan_activity(rows: DataFrame, min_vol_oi: float) -> DataFrame:
    """Rows at or above the ratio, highest first with a fixed tie order; an unknown ratio never passes."""
    return rows.filter(F.col("vol_oi_ratio") >= min_vol_oi).orderBy(
        F.col("vol_oi_ratio").desc_nulls_last(), F.col("ticker").asc_nulls_last(), F.col("type").asc_nulls_last(),
        F.col("strike").asc_nulls_last(), F.col("expiry").asc_nulls_last(), F.col("volume").desc_nulls_last(),
    )


def put_call_activity(rows: DataFrame) -> DataFrame:
    """Put and call volume per ticker, their ratio and a non-directional balance label."""
    of = lambda t: F.floor(F.coalesce(F.sum(F.when(F.upper("type") == t, F.when(F.col("volume") >= 0, F.col("volume")))), F.lit(0.0)))
    sums = rows.groupBy("ticker").agg(of("PUT").alias("put_volume"), of("CALL").alias("call_volume"))
    put, call = F.col("put_volume"), F.col("call_volume")
    ratio = F.when(call > 0, put / call)
    balance = (
        F.when((call == 0) & (put == 0), "unknown").when(call == 0, "put_only").when(put == 0, "call_only")
        .when(ratio < 0.7, "call_heavy").when(ratio > 1.2, "put_heavy").otherwise("balanced")
    )
    return sums.withColumns({"put_call_volume_ratio": ratio, "volume_balance": balance})


def scan_report(requested: DataFrame, rows: DataFrame, failures: DataFrame, min_vol_oi: float) -> DataFrame:
    """Counters and status of one scan; a ticker without a failure row counts as fetched."""
    failed = requested.join(failures, "ticker", "left_semi").agg(F.count(F.lit(1)).alias("total_failures"))
    asked = requested.agg(F.count(F.lit(1)).alias("total_requested"))
    matched = rows.agg(F.count_if(F.col("vol_oi_ratio") >= min_vol_oi).alias("total_matches"))
    out = asked.crossJoin(failed).crossJoin(matched).withColumn("total_fetched", F.col("total_requested") - F.col("total_failures"))
    status = (
        F.when((F.col("total_failures") > 0) & (F.col("total_fetched") > 0), "partial_failure")
        .when(F.col("total_failures") > 0, "complete_failure").when(F.col("total_matches") == 0, "no_matches").otherwise("completed")
    )
    return out.withColumn("status", status)
