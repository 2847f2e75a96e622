"""Streams, alert cooldowns and stored tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.config import AlertCooldowns
from barloom.operators.calendar import calendar_of, local_day
from barloom.plans import alerts as al
from barloom.session import checkpoint_dir, settle
from barloom.sinks import tables as tb
from barloom.sources import bars as src
from barloom.streaming import bars as sb
from barloom.streaming import passes as ps
from barloom.streaming import sessions as ses
from oracle.sql import day, event_bars, minute, r, with_

from .base import query, tidy

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/barloom-{name}-{uuid.uuid4().hex}"


def _ticks(spark, sf):
    return sb.stream_ticks(spark, sf, EVENT_SCHEMA, "events.parquet", "ts", "event_type", "value", "event_id")


@query(
    "stream_hourly_bars",
    with_(event_bars(60), select=f"SELECT ticker, {minute('ts')} AS ts, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, {r('volume')} AS volume FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"),
)
def _(spark, sf):
    sink = _scratch(spark, "bars")
    sb.run_available(sb.stream_bars(_ticks(spark, sf), 60), sink, _scratch(spark, "ckpt"))
    out = spark.read.schema("ticker string, ts timestamp, open double, high double, low double, close double, volume double").parquet(sink)
    return tidy(out, minutes=True)


def _land(df, spark, name, chunk, chunks):
    """A table landed as one file per chunk, in order, for a stream that reads one file a micro-batch."""
    where, rows = _scratch(spark, name), settle(df.withColumn("_chunk", chunk))
    for i in range(chunks):
        rows.filter(F.col("_chunk") == i).drop("_chunk").coalesce(1).write.mode("append").parquet(where)
    return spark.readStream.schema(rows.drop("_chunk").schema).option("maxFilesPerTrigger", 1).parquet(where)


# Hourly bars, each sent twice (the first version without the hour's last price), and some bars that claim a time thirty days ahead.
REPLAY_CHUNKS = 4
VERSIONS = f"""
{event_bars(60)},
span AS (SELECT min(ts) AS t0, max(ts) AS t1 FROM bars),
vw AS (SELECT ticker, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS d, ts, (high + low + close) / 3 * volume AS pv, volume FROM bars)"""


def replayed_bars(spark, sf):
    bars = settle(src.event_bars(spark, sf, 60))
    first = bars.agg(F.min("ts")).first()[0]
    hours = (F.unix_seconds("ts") - F.unix_seconds(F.lit(first))) / 3600
    chunk = F.least(F.floor(hours / (24 * 8)), F.lit(REPLAY_CHUNKS - 1)).cast("int")
    later = F.least(F.floor((hours + 2) / (24 * 8)), F.lit(REPLAY_CHUNKS - 1)).cast("int")  # corrections of a chunk's last two hours come with the next chunk
    received = F.timestamp_seconds(F.unix_seconds("ts") + 3600)
    early = bars.withColumns({"close": F.col("open"), "volume": F.col("volume") / 2, "arrival": F.lit(0).cast("bigint"), "received_at": received, "_c": chunk})
    final = bars.withColumns({"arrival": F.lit(1).cast("bigint"), "received_at": received, "_c": later})
    ahead = bars.filter(F.hour("ts") == 5).withColumns({"received_at": received, "ts": F.timestamp_seconds(F.unix_seconds("ts") + 30 * 86_400), "arrival": F.lit(2).cast("bigint"), "_c": chunk})
    every = early.unionByName(final).unionByName(ahead)
    return _land(every, spark, "replay", F.col("_c"), REPLAY_CHUNKS).drop("_c")


@query(
    "session_vwap_stream",
    with_(VERSIONS, select=f"""
SELECT ticker, {day('d')} AS session_date, 'session' AS kind, {minute('max(ts)')} AS bar_time, count(*) AS bars, {r('sum(pv) / sum(volume)', 6)} AS vwap FROM vw
GROUP BY ticker, d HAVING ((d + INTERVAL 1 DAY)::TIMESTAMP AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' < (SELECT t1 - INTERVAL 3 HOUR FROM span)
UNION ALL
SELECT ticker, {day("(((ts + INTERVAL 30 DAY) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE")}, 'future_bar', {minute('ts + INTERVAL 30 DAY')}, NULL, NULL FROM bars WHERE hour(ts) = 5"""),
)
def _(spark, sf):
    """Bars replayed in several micro-batches, with corrections and bars from the future: every closed session once."""
    sink = _scratch(spark, "vwap")
    sb.run_available(ses.session_vwaps(replayed_bars(spark, sf)), sink, _scratch(spark, "ckpt"), settings=ses.STATE_STORE)
    return tidy(spark.read.schema(ses.OUT).parquet(sink), 6, minutes=True).withColumn("session_date", F.substring("session_date", 1, 10))


@query(
    "trading_day_passes",
    with_(event_bars(60), select=f"""
SELECT {day('d')} AS scan_date, {minute("((d + INTERVAL 990 MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'")} AS scan_time, CASE WHEN isodow(d) < 6 THEN {day('d')} END AS trading_date, count(*) AS landed_rows, CASE WHEN isodow(d) < 6 THEN 'scanned' ELSE 'skipped_closed' END AS status,
  CASE WHEN isodow(d) < 6 THEN count(DISTINCT ticker) END AS tickers, CASE WHEN isodow(d) < 6 THEN {r('max(high)')} END AS highest
FROM (SELECT *, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS d FROM bars) GROUP BY d"""),
)
def _(spark, sf):
    """A daily pass over landed bars, run twice over the same landing: the second run finds nothing to do."""
    bars = settle(src.event_bars(spark, sf, 60))
    first = bars.agg(F.min(local_day("ts"))).first()[0]
    chunk = F.least(F.floor(F.datediff(local_day("ts"), F.lit(first)) / 8), F.lit(REPLAY_CHUNKS - 1)).cast("int")
    stream = _land(bars, spark, "landed", chunk, REPLAY_CHUNKS)
    root, checkpoint, sessions = _scratch(spark, "passes"), _scratch(spark, "ckpt"), settle(calendar_of(bars))
    for _ in range(2):
        ps.run_pass(stream, sessions, lambda b: b.groupBy("scan_date", "ticker").agg(F.max("high").alias("high")), root, "outcomes", checkpoint)
    ledger, results = ps.committed(spark, root)
    found = results.groupBy("scan_date").agg(F.count(F.lit(1)).alias("tickers"), F.max("high").alias("highest"))
    out = ledger.drop("query_id", "batch_id").join(found, "scan_date", "left")
    shown = {c: F.date_format(c, "yyyy-MM-dd") for c in ("scan_date", "trading_date")}
    return tidy(out.withColumns(shown), minutes=True)


COOL = AlertCooldowns(default_minutes=60, by_type={"coil": 240, "pattern": 30})
ALERTS = """
al AS MATERIALIZED (
  SELECT upper(event_type) AS ticker, CASE WHEN value < 10 THEN 'coil' WHEN value < 20 THEN 'confluence' WHEN value < 40 THEN 'pattern_runup' ELSE 'gap_large' END AS alert_type, epoch_us(ts) AS s, event_id % 5 <> 0 AS delivered, event_id FROM events),
an AS MATERIALIZED (SELECT *, s + CASE WHEN delivered THEN CASE alert_type WHEN 'coil' THEN 14400 WHEN 'pattern_runup' THEN 1800 ELSE 3600 END * 1000000::BIGINT ELSE 0 END AS f, row_number() OVER (PARTITION BY ticker, alert_type ORDER BY s, event_id) AS k FROM al),
wa AS (
  SELECT ticker, alert_type, k, f AS held, true AS open FROM an WHERE k = 1
  UNION ALL SELECT a.ticker, a.alert_type, a.k, CASE WHEN a.s >= w.held THEN a.f ELSE w.held END, a.s >= w.held FROM wa w JOIN an a ON a.ticker = w.ticker AND a.alert_type = w.alert_type AND a.k = w.k + 1)"""


def alert_rows(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    v = F.col("value")
    kind = F.when(v < 10, "coil").when(v < 20, "confluence").when(v < 40, "pattern_runup").otherwise("gap_large")
    return ev.select(F.col("event_type").alias("ticker"), kind.alias("alert_type"), F.lit("All").alias("timeframe"), F.col("ts").cast("timestamp").alias("observed_at"), (F.col("event_id") % 5 != 0).alias("delivered"), "event_id")


@query(
    "alert_cooldown_state",
    with_(ALERTS, select="SELECT ticker, alert_type, count(*) FILTER (open AND delivered) AS sent, count(*) FILTER (NOT open) AS suppressed, count(*) FILTER (open AND NOT delivered) AS failed FROM wa JOIN an USING (ticker, alert_type, k) GROUP BY 1, 2"),
)
def _(spark, sf):
    return al.alert_state(al.decide(al.normalize_key(alert_rows(spark, sf)), COOL, ["event_id"])).select("ticker", "alert_type", "sent", "suppressed", "failed")


@query(
    "alert_cooldown_stream",
    with_(ALERTS, select=f"""
SELECT ticker, alert_type, count(*) FILTER (open AND delivered) AS sent, count(*) FILTER (NOT open) AS suppressed, count(*) FILTER (open AND NOT delivered) AS failed FROM wa JOIN an USING (ticker, alert_type, k) WHERE s // 1000 < (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events) GROUP BY 1, 2"""),
)
def _(spark, sf):
    """The same decisions on a stream of four micro-batches, in whatever order alerts arrive within the watermark."""
    rows = alert_rows(spark, sf)
    first = rows.agg(F.min("observed_at")).first()[0]
    chunk = F.least(F.floor((F.unix_seconds("observed_at") - F.unix_seconds(F.lit(first))) / (86_400 * 8)), F.lit(REPLAY_CHUNKS - 1)).cast("int")
    stream = _land(al.normalize_key(rows).orderBy(F.xxhash64("event_id")), spark, "alerts", chunk, REPLAY_CHUNKS).withColumn("tie", F.lpad(F.col("event_id").cast("string"), 20, "0"))
    sink = _scratch(spark, "decisions")
    sb.run_available(ses.cooldown_decisions(stream, COOL, "tie"), sink, _scratch(spark, "ckpt"), settings=ses.STATE_STORE)
    out = spark.read.schema(ses.DECIDED).parquet(sink)
    return out.groupBy("ticker", "alert_type").agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("sent", "suppressed", "failed")])


@query(
    "earnings_cache_fresh",
    with_(select=f"""
SELECT c_mktsegment AS ticker, o_orderpriority AS source, {day('arg_max(nxt, (t, nxt))')} AS next_earnings FROM (SELECT c_mktsegment, o_orderpriority, o_orderdate AS t, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderdate + to_days((o_orderkey % 30)::INT))::DATE END AS nxt FROM orders JOIN customer ON c_custkey = o_custkey)
WHERE nxt IS NOT NULL AND t > TIMESTAMP '1998-06-01' - INTERVAL 240 HOUR AND t <= TIMESTAMP '1998-06-01' GROUP BY 1, 2""").replace("WITH RECURSIVE \n", ""),
)
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment")
    at = F.col("o_orderdate").cast("timestamp")
    cache = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("ticker"), F.col("o_orderpriority").alias("source"), at.alias("fetched_at"),
        F.when(F.col("o_orderkey") % 4 != 0, F.to_date(F.timestamp_seconds(F.unix_seconds(at) + (F.col("o_orderkey") % 30) * 86_400))).alias("next_earnings"))
    return tidy(tb.fresh_earnings(cache, "1998-06-01", 240).select("ticker", "source", "next_earnings"))


@query("watchlist_counts", with_(select="SELECT c_mktsegment AS name, count(*) AS tickers FROM customer GROUP BY 1").replace("WITH RECURSIVE \n", ""))
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    t = F.lit("2024-01-01").cast("timestamp")
    members = c.select(F.col("c_mktsegment").alias("name"), F.col("c_name").alias("ticker"), F.col("c_custkey").cast("int").alias("pos"), t.alias("created_at"), t.alias("updated_at"))
    return tb.list_watchlists(members).select("name", "tickers")
