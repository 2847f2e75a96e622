"""Calendar, pre-market gaps, catalysts and options."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.config import GapScanConfig
from barloom.operators import calendar as cal
from barloom.plans import context as cx
from barloom.plans import options as op
from barloom.plans import premarket as pm
from barloom.sources import bars as src
from oracle.sql import DAILY, day, event_bars, minute, r, with_

from .base import query, tidy
from .studies import SPLITS, split_sql

GROUPS = 4
EVENT_BARS = event_bars(5, "bars", GROUPS)
# early closes of the test calendar: every 24th of a month
SESSIONS = """
dayspan AS MATERIALIZED (SELECT unnest(generate_series((SELECT min(ts) FROM bars)::DATE - INTERVAL 7 DAY, (SELECT max(ts) FROM bars)::DATE + INTERVAL 7 DAY, INTERVAL 1 DAY))::DATE AS d),
sess AS MATERIALIZED (
  SELECT d, row_number() OVER (ORDER BY d) AS no, day(d) = 24 AS early, max(d) OVER (PARTITION BY date_trunc('week', d)) AS we,
    ((d + INTERVAL 570 MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS opens,
    ((d + CASE WHEN day(d) = 24 THEN INTERVAL 780 MINUTE ELSE INTERVAL 960 MINUTE END) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS closes
  FROM dayspan WHERE isodow(d) < 6)"""
LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


def event_calendar(bars):
    return cal.calendar_of(bars, early_close=F.dayofmonth("session_date") == 24)


def parts(spark, sf):
    bars = src.event_bars(spark, sf, 5, GROUPS)
    return bars, event_calendar(src.event_bars(spark, sf, 60))


@query("calendar_sessions", with_(event_bars(60), SESSIONS, select=f"SELECT {day('d')} AS session_date, no AS session_no, {day('we')} AS week_end_session, early AS is_early_close, {minute('opens')} AS opens_at, {minute('closes')} AS closes_at FROM sess"))
def _(spark, sf):
    s = event_calendar(src.event_bars(spark, sf, 60)).select("session_date", "session_no", "week_end_session", "is_early_close", F.date_format("opens_at", "yyyy-MM-dd HH:mm").alias("opens_at"), F.date_format("closes_at", "yyyy-MM-dd HH:mm").alias("closes_at"))
    return tidy(s)


@query(
    "market_status_of_bars",
    with_(event_bars(60), SESSIONS, select=f"""
SELECT ticker, {minute('ts')} AS ts, CASE WHEN s.d IS NULL THEN 'Weekend or exchange holiday' WHEN ts < opens THEN 'Before regular session' WHEN ts < closes THEN 'Regular session open' ELSE 'After regular session' END AS reason,
  {minute("CASE WHEN s.d IS NOT NULL AND ts < opens THEN opens WHEN s.d IS NOT NULL AND ts < closes THEN NULL ELSE (SELECT min(opens) FROM sess n WHERE n.d > b.ld) END")} AS next_open
FROM (SELECT *, {LOCAL}::DATE AS ld FROM bars) b LEFT JOIN sess s ON s.d = ld"""),
)
def _(spark, sf):
    bars = src.event_bars(spark, sf, 60)
    m = cal.market_status(bars.select("ticker", "ts"), event_calendar(bars))
    return tidy(m.select("ticker", "ts", "reason", "next_open"), minutes=True)


@query(
    "session_grid_size",
    with_(event_bars(60), SESSIONS, select=f"SELECT {day('d')} AS session_date, 78::BIGINT AS bars, {minute('opens')} AS first_bar, {minute('opens + INTERVAL 385 MINUTE')} AS last_bar FROM sess WHERE NOT early"),
)
def _(spark, sf):
    g = cal.session_grid(event_calendar(src.event_bars(spark, sf, 60)), 5)
    return tidy(g.groupBy(F.date_format("session_date", "yyyy-MM-dd").alias("session_date")).agg(F.count(F.lit(1)).alias("bars"), F.min("bar_start").alias("first_bar"), F.max("bar_start").alias("last_bar")), minutes=True)


@query(
    "prior_sessions",
    with_(event_bars(60), SESSIONS, select=f"SELECT {day('a.d')} AS session_date, {day('b.d')} AS prior_date, a.no - b.no AS back FROM sess a JOIN sess b ON b.no BETWEEN a.no - 5 AND a.no - 1"),
)
def _(spark, sf):
    return tidy(cal.prior_sessions(event_calendar(src.event_bars(spark, sf, 60)), 5))


@query(
    "split_of_bars",
    with_(DAILY, select=f"SELECT coalesce({split_sql('ts')}, 'none') AS split, strftime(ts, '%Y-%m') AS month, count(*) AS bars FROM bars GROUP BY 1, 2"),
)
def _(spark, sf):
    b = src.daily_bars(spark, sf)
    return b.groupBy(F.coalesce(cal.in_split(F.to_date("ts"), SPLITS), F.lit("none")).alias("split"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("bars"))


@query(
    "bar_staleness",
    with_(DAILY, select="""
SELECT ticker, count(*) FILTER (n > 2) AS stale, count(*) AS bars FROM (
  SELECT ticker, (SELECT count(*) FROM (SELECT unnest(generate_series(p, t, INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6) AS n
  FROM (SELECT ticker, ts::DATE AS t, lag(ts) OVER (PARTITION BY ticker ORDER BY ts)::DATE AS p FROM bars) WHERE p IS NOT NULL) GROUP BY ticker"""),
)
def _(spark, sf):
    from barloom.operators.blocks import block_window, lay_out, owned
    laid = lay_out(src.daily_bars(spark, sf).select("ticker", "ts"), ["ticker"], "ts", 1)
    gaps = owned(laid.withColumn("p", F.lag("ts").over(block_window(["ticker"])))).filter("p IS NOT NULL")
    return gaps.groupBy("ticker").agg(F.count_if(cal.is_stale(F.col("p"), F.col("ts"))).alias("stale"), F.count(F.lit(1)).alias("bars"))


GAP = GapScanConfig(min_abs_gap_pct=2.0, min_price=5.0, min_premarket_volume=2, min_premarket_volume_ratio=0.05, max_data_age_minutes=120.0, liquidity_lookback_sessions=5)
PREMARKET = f"""
lb AS MATERIALIZED (SELECT *, {LOCAL} AS lt FROM bars),
dly AS MATERIALIZED (
  SELECT ticker, s.d, s.no, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume
  FROM lb JOIN sess s ON s.d = lt::DATE AND NOT early AND ts >= opens AND ts < closes GROUP BY 1, 2, 3),
req AS MATERIALIZED (SELECT ticker, d, no, opens - INTERVAL 15 MINUTE AS as_of FROM (SELECT DISTINCT ticker FROM bars) CROSS JOIN sess),
snp AS MATERIALIZED (
  SELECT q.ticker, q.d, count(*) AS n, first(open ORDER BY ts) AS po, max(high) AS ph, min(low) AS pl, last(close ORDER BY ts) AS plast, sum(volume) AS pv,
    sum((high + low + close) / 3 * volume) AS pdv, max(ts) AS lastbar, bool_or(low <= 0 OR open <= 0 OR high <= 0 OR close <= 0) AS bad
  FROM req q JOIN lb ON lb.ticker = q.ticker AND lt::DATE = q.d AND lt >= q.d + INTERVAL 240 MINUTE AND ts <= q.as_of GROUP BY 1, 2),
bse AS MATERIALIZED (
  SELECT q.ticker, q.d, count(*) AS n, avg(volume) AS av, median(volume) AS mv, avg(close * volume) AS adv, median(close * volume) AS mdv, max(close) FILTER (y.no = q.no - 1) AS pc
  FROM req q JOIN dly y ON y.ticker = q.ticker AND y.no BETWEEN q.no - 5 AND q.no - 1 GROUP BY 1, 2),
gp AS MATERIALIZED (
  SELECT q.ticker, q.d, b.n AS bn, av, mv, adv, mdv, pc, s.n AS sn, po, ph, pl, plast, pv, pdv, epoch(as_of - lastbar) / 60 AS age, bad,
    CASE WHEN pc > 0 THEN (plast - pc) / pc * 100 END AS gap, CASE WHEN av > 0 THEN pv / av END AS ratio
  FROM req q LEFT JOIN bse b USING (ticker, d) LEFT JOIN snp s USING (ticker, d)),
gs AS MATERIALIZED (
  SELECT *, CASE WHEN pc IS NULL OR pc <= 0 THEN 'no_previous_close' WHEN sn IS NULL THEN 'no_premarket_data' WHEN bad THEN 'calculation_failure' WHEN abs(gap) < 2 THEN 'below_gap_threshold'
    WHEN plast < 5 THEN 'price_filtered' WHEN age > 120 THEN 'stale_data' WHEN pv < 2 THEN 'liquidity_filtered' WHEN ratio IS NULL OR ratio < 0.05 THEN 'liquidity_filtered' ELSE 'qualified' END AS status FROM gp)"""


def requests(bars, sessions):
    tickers = bars.select("ticker").distinct()
    return tickers.crossJoin(F.broadcast(sessions.select("session_date", (F.col("opens_at") - F.expr("INTERVAL 15 MINUTES")).alias("as_of"))))


def gaps(spark, sf):
    bars, sessions = parts(spark, sf)
    return pm.scan_gaps(requests(bars, sessions), bars, pm.daily_from_intraday(bars, sessions), sessions, GAP)


@query("daily_from_intraday", with_(EVENT_BARS, SESSIONS, PREMARKET, select=f"SELECT ticker, {day('d')} AS session_date, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, {r('volume')} AS volume FROM dly"))
def _(spark, sf):
    bars, sessions = parts(spark, sf)
    return tidy(pm.daily_from_intraday(bars, sessions))


@query(
    "premarket_snapshots",
    with_(EVENT_BARS, SESSIONS, PREMARKET, select=f"""
SELECT ticker, {day('d')} AS session_date, n AS bar_count, {r('po')} AS premarket_open, {r('ph')} AS premarket_high, {r('pl')} AS premarket_low, {r('plast')} AS premarket_last, {r('pv')} AS premarket_volume,
  {r('pdv')} AS premarket_dollar_volume, {r('pdv / pv', 6)} AS premarket_vwap, {r('epoch((SELECT as_of FROM req WHERE req.ticker = snp.ticker AND req.d = snp.d) - lastbar) / 60')} AS data_age_minutes FROM snp"""),
)
def _(spark, sf):
    bars, sessions = parts(spark, sf)
    s = pm.snapshots(requests(bars, sessions), bars, sessions).drop("first_bar_time", "last_bar_time", "bad_bars")
    keys = ["ticker", "session_date"]
    return tidy(s.drop("premarket_vwap")).join(tidy(s.select(*keys, "premarket_vwap"), 6), keys)


@query(
    "liquidity_baselines",
    with_(EVENT_BARS, SESSIONS, PREMARKET, select=f"""
SELECT ticker, {day('d')} AS session_date, n AS liquidity_lookback_sessions, {r('av')} AS average_daily_volume, {r('mv')} AS median_daily_volume, {r('adv', 6)} AS average_daily_dollar_volume,
  {r('mdv', 6)} AS median_daily_dollar_volume, {r('pc')} AS prev_close FROM bse"""),
)
def _(spark, sf):
    bars, sessions = parts(spark, sf)
    b = pm.liquidity_baselines(requests(bars, sessions), pm.daily_from_intraday(bars, sessions), sessions, 5)
    keys = ["ticker", "session_date"]
    return tidy(b.drop("average_daily_dollar_volume", "median_daily_dollar_volume")).join(tidy(b.select(*keys, "average_daily_dollar_volume", "median_daily_dollar_volume"), 6), keys)


@query(
    "premarket_gap_scan",
    with_(EVENT_BARS, SESSIONS, PREMARKET, select=f"""
SELECT ticker, {day('d')} AS session_date, status, CASE WHEN status NOT IN ('no_previous_close', 'no_premarket_data', 'calculation_failure') THEN {r('gap', 3)} END AS gap_pct,
  CASE WHEN status NOT IN ('no_previous_close', 'no_premarket_data', 'calculation_failure') THEN CASE WHEN abs(gap) >= 8 THEN 'massive' WHEN abs(gap) >= 4 THEN 'large' WHEN abs(gap) >= 2 THEN 'moderate' ELSE 'small' END END AS tier,
  CASE WHEN status NOT IN ('no_previous_close', 'no_premarket_data', 'calculation_failure') THEN CASE WHEN gap > 0 THEN 'up' WHEN gap < 0 THEN 'down' ELSE 'flat' END END AS direction,
  {r('ratio')} AS premarket_volume_ratio, {r('(plast / po - 1) * 100', 3)} AS premarket_move_pct, {r('CASE WHEN pc > 0 AND pl > 0 THEN (ph - pl) / pc * 100 END', 3)} AS premarket_range_pct FROM gs"""),
)
def _(spark, sf):
    g = gaps(spark, sf)
    keys = ["ticker", "session_date"]
    return tidy(g.select(*keys, "status", "gap_pct", "tier", "direction", "premarket_move_pct", "premarket_range_pct"), 3).join(tidy(g.select(*keys, "premarket_volume_ratio")), keys)


@query("gap_status_counts", with_(EVENT_BARS, SESSIONS, PREMARKET, select="SELECT status, count(*) AS observations FROM gs GROUP BY 1"))
def _(spark, sf):
    return pm.status_counts(gaps(spark, sf))


# customer orders as headlines: segment = ticker, order time of day = publication time
HEADLINES = """
hd AS MATERIALIZED (SELECT c_mktsegment AS ticker, o_orderdate + to_minutes((o_orderkey % 1440)::BIGINT) AS pub, o_orderpriority || ' ' || o_orderkey AS title FROM orders JOIN customer ON c_custkey = o_custkey),
hq AS MATERIALIZED (SELECT DISTINCT ticker, pub::DATE AS d FROM hd),
hl AS MATERIALIZED (
  SELECT q.ticker, q.d, h.pub, h.title FROM hq q JOIN hd h ON h.ticker = q.ticker AND h.pub <= q.d + INTERVAL 8 HOUR AND h.pub >= q.d - INTERVAL 16 HOUR
  QUALIFY row_number() OVER (PARTITION BY q.ticker, q.d ORDER BY h.pub DESC, h.title) = 1),
ne AS (SELECT q.ticker, q.d, (SELECT min(h.d) FROM hq h WHERE h.ticker = q.ticker AND h.d >= q.d AND day(h.d) = 15) AS e FROM hq q)"""


def headline_parts(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cust = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment")
    h = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("ticker"),
        F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 1440) * 60).alias("published_at"),
        F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("title"), F.lit(None).cast("string").alias("url"), F.lit("desk").alias("publisher"),
    )
    req = h.select("ticker", F.to_date("published_at").alias("session_date")).distinct().withColumn("as_of", F.col("session_date").cast("timestamp") + F.expr("INTERVAL 8 HOURS"))
    return h, req


@query("newest_headlines", with_(HEADLINES, select=f"SELECT ticker, {day('d')} AS session_date, {minute('pub')} AS published, title AS headline_title FROM hl"))
def _(spark, sf):
    h, req = headline_parts(spark, sf)
    n = pm.newest_headlines(req, h, 24.0)
    return tidy(n.select("ticker", F.date_format("session_date", "yyyy-MM-dd").alias("session_date"), F.date_format("headline_published_at", "yyyy-MM-dd HH:mm").alias("published"), "headline_title"))


@query(
    "catalyst_status",
    with_(HEADLINES, select=f"""
SELECT ticker, {day('d')} AS session_date, CASE WHEN e IS NOT NULL AND e - d <= 1 AND hl.title IS NOT NULL THEN 'earnings_and_recent_headline' WHEN e = d THEN 'earnings_today' WHEN e - d = 1 THEN 'earnings_soon'
  WHEN hl.title IS NOT NULL THEN 'recent_headline' WHEN e IS NULL THEN 'unavailable' ELSE 'none_detected' END AS catalyst_status FROM ne LEFT JOIN hl USING (ticker, d)"""),
)
def _(spark, sf):
    h, req = headline_parts(spark, sf)
    # next earnings: the segment's next active 15th of a month
    dates = req.filter(F.dayofmonth("session_date") == 15).select("ticker", "session_date")
    nxt = cx.next_on_or_after(req.select("ticker", "session_date"), dates, ["ticker"], "session_date", "next_earnings")
    n = pm.newest_headlines(req, h, 24.0)
    out = nxt.join(n, ["ticker", "session_date"], "left")
    status = pm.catalyst_status(pm.earnings_status(F.col("next_earnings"), F.col("session_date"), 24.0), F.when(F.col("headline_title").isNotNull(), "recent_headline").otherwise("none_detected"))
    return tidy(out.select("ticker", "session_date", status.alias("catalyst_status")))


FLOW = """
raw AS (SELECT p_brand AS ticker, CASE l_returnflag WHEN 'R' THEN 'put' WHEN 'A' THEN 'C' ELSE ' call ' END AS pc, l_linestatus AS side, p_retailprice AS strike, strftime(l_shipdate, '%Y-%m-%d') AS expiry,
    l_extendedprice AS premium, l_quantity AS volume, (l_linenumber - 1) * 2e0 AS oi, CASE WHEN l_tax = 0 THEN 'Yes' WHEN l_tax = 0.01 THEN 'N' ELSE 'maybe' END AS sweep FROM lineitem JOIN part ON l_partkey = p_partkey),
fl AS MATERIALIZED (SELECT ticker, CASE upper(trim(pc)) WHEN 'C' THEN 'CALL' WHEN 'CALL' THEN 'CALL' ELSE 'PUT' END AS type, side, strike, expiry, premium, volume, oi AS open_interest,
    CASE WHEN oi > 0 THEN volume / oi END AS vol_oi_ratio, CASE lower(sweep) WHEN 'yes' THEN true WHEN 'n' THEN false END AS is_sweep FROM raw)"""


def flow_rows(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_retailprice")
    rec = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("ticker"), F.when(F.col("l_returnflag") == "R", "put").when(F.col("l_returnflag") == "A", "C").otherwise(" call ").alias("put_call"),
        F.col("l_linestatus").alias("side"), F.col("p_retailprice").cast("string").alias("strike_price"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("expiry_date"),
        F.col("l_extendedprice").cast("string").alias("premium"), F.col("l_quantity").cast("string").alias("volume"), ((F.col("l_linenumber") - 1) * 2).cast("string").alias("open_interest"),
        F.when(F.col("l_tax") == 0, "Yes").when(F.col("l_tax") == 0.01, "N").otherwise("maybe").alias("is_sweep"), F.lit(" ").alias("sentiment"), F.lit(None).cast("string").alias("created_at"),
    )
    return op.normalize_flow(rec, "auto", "landed")


@query("options_flow", with_(FLOW, select=f"SELECT ticker, type, side, {r('strike')} AS strike, expiry, {r('premium')} AS premium, {r('volume')} AS volume, {r('open_interest')} AS open_interest, {r('vol_oi_ratio')} AS vol_oi_ratio, is_sweep FROM fl"))
def _(spark, sf):
    return tidy(flow_rows(spark, sf).select("ticker", "type", "side", "strike", "expiry", "premium", "volume", "open_interest", "vol_oi_ratio", "is_sweep"))


@query("unusual_flow_scan", with_(FLOW, select=f"SELECT ticker, type, {r('strike')} AS strike, expiry, {r('volume')} AS volume, {r('vol_oi_ratio')} AS vol_oi_ratio FROM fl WHERE vol_oi_ratio >= 10"))
def _(spark, sf):
    return tidy(op.scan_activity(flow_rows(spark, sf), 10.0).select("ticker", "type", "strike", "expiry", "volume", "vol_oi_ratio"))


@query(
    "put_call_activity",
    with_(FLOW, select=f"""
SELECT ticker, p AS put_volume, c AS call_volume, {r('p / c')} AS put_call_volume_ratio, CASE WHEN p / c < 0.7 THEN 'call_heavy' WHEN p / c > 1.2 THEN 'put_heavy' ELSE 'balanced' END AS volume_balance
FROM (SELECT ticker, floor(sum(volume) FILTER (type = 'PUT'))::BIGINT AS p, floor(sum(volume) FILTER (type = 'CALL'))::BIGINT AS c FROM fl GROUP BY 1)"""),
)
def _(spark, sf):
    return tidy(op.put_call_activity(flow_rows(spark, sf)))


@query(
    "options_scan_report",
    with_(FLOW, select="""
SELECT count(DISTINCT ticker) AS total_requested, count(DISTINCT ticker) FILTER (ticker LIKE '%3') AS total_failures, count(*) FILTER (vol_oi_ratio >= 10) AS total_matches,
  count(DISTINCT ticker) FILTER (ticker NOT LIKE '%3') AS total_fetched, 'partial_failure' AS status FROM fl"""),
)
def _(spark, sf):
    rows = flow_rows(spark, sf)
    asked = rows.select("ticker").distinct()
    return tidy(op.scan_report(asked, rows, asked.filter("ticker LIKE '%3'"), 10.0))


@query(
    "chain_activity",
    with_(FLOW, select=f"SELECT ticker, type, count(*) AS contracts, {r('sum(volume)')} AS volume, {r('max(vol_oi_ratio)')} AS max_ratio, count(vol_oi_ratio) AS known_ratios FROM fl GROUP BY 1, 2"),
)
def _(spark, sf):
    f = flow_rows(spark, sf)
    chain = f.select("ticker", F.lower("type").alias("option_type"), F.col("expiry").alias("expiration_date"), "strike", "volume", F.col("open_interest").alias("openInterest"), F.col("premium").alias("lastPrice"))
    c = op.normalize_chain(chain, "auto", "landed")
    return tidy(c.groupBy("ticker", "type").agg(F.count(F.lit(1)).alias("contracts"), F.sum("volume").alias("volume"), F.max("vol_oi_ratio").alias("max_ratio"), F.count("vol_oi_ratio").alias("known_ratios")))
