"""Screener, confluence, scan history, outcomes and market context."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators.blocks import owned
from barloom.operators.indicators import with_indicators
from barloom.operators.scores import add_short_score
from barloom.plans import context as cx
from barloom.plans import history as hs
from barloom.plans import screener as sn
from barloom.session import settle
from barloom.sources import bars as src
from oracle.sql import DAILY, MARKET, day, event_bars, indicators, numbered, r, short_scores, with_

from .base import query, tidy
from .bars import EXPANDING, INTRADAY_SCORE, LAST_RANK, LONG_SCORE, WEEKLY, recent, weekly
from .patterns import rnd_even
from .studies import EVENTS, SCORED, SPLITS, STUDY, split_sql

# ---- confluence: one bar table read as three timeframes ------------------------------------------
SHORT_PART = f"""
{recent('bars', 60, 's60')}, {numbered('s60', 'sb')}, {indicators('sb', 'si')}, {short_scores('si', 'ss')},
short_last AS (SELECT ticker, score, close FROM ss WHERE pos >= 29 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) = 1)"""


def renamed_rank(prefix, score):
    return LAST_RANK.replace("lr AS", f"{prefix}lr AS").replace("FROM lr", f"FROM {prefix}lr").replace("lst AS", f"{prefix}lst AS").replace("FROM ind i", f"FROM {prefix}ind i") + f""",
{prefix}last AS (SELECT ticker, {score} AS score, close FROM {prefix}lst WHERE pos >= 29)"""


INTRA_PART = f"{recent('bars', 390, 'i390')}, {numbered('i390', 'ib')}, {indicators('ib', 'iind')}, {renamed_rank('i', INTRADAY_SCORE)}"
LONG_PART = f"{WEEKLY}, {recent('wk', 104, 'w104')}, {numbered('w104', 'wb')}, {indicators('wb', 'wind')}, {renamed_rank('w', LONG_SCORE)}"
CONF = """
conf AS (
  SELECT ticker, i.score AS score_intraday, s.score AS score_short, w.score AS score_long,
    round_even(0e0 + coalesce(i.score, 0) * 0.3e0 + coalesce(s.score, 0) * 0.4e0 + coalesce(w.score, 0) * 0.3e0, 0)::BIGINT AS c,
    (i.score IS NOT NULL)::INT + (s.score IS NOT NULL)::INT + (w.score IS NOT NULL)::INT AS n,
    coalesce(i.score >= 50, false)::INT + coalesce(s.score >= 50, false)::INT + coalesce(w.score >= 50, false)::INT AS a,
    coalesce(i.close, s.close, w.close) AS last_close
  FROM ilast i FULL JOIN short_last s USING (ticker) FULL JOIN wlast w USING (ticker))"""


@query(
    "confluence_screen",
    with_(DAILY, SHORT_PART, INTRA_PART, LONG_PART, CONF, select=f"""
SELECT ticker, c AS confluence_score, CASE WHEN n = 3 AND a = 3 AND c >= 90 THEN 'all timeframes aligned' WHEN a >= 2 AND c >= 70 THEN 'strong confluence'
  WHEN a >= 2 AND c >= 50 THEN 'moderate confluence' WHEN n = 1 THEN 'weak / single timeframe' WHEN n = 2 THEN 'weak / incomplete timeframes' ELSE 'weak confluence' END AS tier,
  n || '/3' AS timeframe_coverage, score_intraday, score_short::BIGINT AS score_short, score_long, {r('last_close', 3)} AS last_close FROM conf"""),
)
def _(spark, sf):
    bars = src.daily_bars(spark, sf)
    scores = {"intraday": sn.latest_scores(bars, "intraday"), "short": sn.latest_scores(bars, "short"), "long": sn.latest_scores(weekly(spark, sf), "long")}
    c = sn.confluence(scores)
    return tidy(c.select("ticker", "confluence_score", "tier", "timeframe_coverage", "score_intraday", "score_short", "score_long", "last_close"), 3)


TODAY = "2000-01-01"
NEXT_EARNINGS = f"""
earn AS (SELECT p_brand AS ticker, min(o_orderdate)::DATE AS next_earnings FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE o_orderdate >= DATE '{TODAY}' AND p_size > 48 GROUP BY 1)"""
SCREEN = f"""
req AS (SELECT DISTINCT p_brand AS ticker FROM part UNION SELECT 'NOSUCH'),
scr AS MATERIALIZED (
  SELECT q.ticker, datediff('day', DATE '{TODAY}', next_earnings) AS d, l.ticker IS NOT NULL AS has, l.pos + 1 AS bars, l.score, l.close, l.volume_ratio, l.rsi
  FROM req q LEFT JOIN earn e ON e.ticker = q.ticker
  LEFT JOIN (SELECT * FROM ss QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) = 1) l ON l.ticker = q.ticker),
scs AS MATERIALIZED (
  SELECT *, CASE WHEN d IS NULL THEN 'earnings_failure' WHEN d BETWEEN 0 AND 2 THEN 'earnings_excluded' WHEN NOT has THEN 'fetch_failure' WHEN bars < 30 THEN 'insufficient_data'
    WHEN score >= 40 THEN 'signal' ELSE 'below_threshold' END AS status FROM scr)"""
SHORT_ALL = f"{recent('bars', 60, 's60')}, {numbered('s60', 'sb')}, {indicators('sb', 'si')}, {short_scores('si', 'ss')}"


def screened(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    requested = part.select(F.col("p_brand").alias("ticker")).distinct().unionByName(part.select(F.lit("NOSUCH").alias("ticker")).distinct())
    orders = spark.read.parquet(f"{sf}/orders.parquet").filter(F.col("o_orderdate") >= F.lit(TODAY).cast("timestamp"))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey")
    earnings = (
        lines.join(part.filter("p_size > 48").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("p_brand").alias("ticker")).agg(F.to_date(F.min("o_orderdate")).alias("next_earnings"))
    )
    scores = sn.latest_scores(src.daily_bars(spark, sf), "short")
    return requested, sn.screen(requested, scores, "short", 40, earnings, TODAY, 2)


@query(
    "screener_observations",
    with_(DAILY, SHORT_ALL, NEXT_EARNINGS, SCREEN, select=f"""
SELECT ticker, status, CASE WHEN status IN ('signal', 'below_threshold') THEN score::BIGINT END AS score, CASE WHEN status IN ('signal', 'below_threshold') THEN {r('close', 3)} END AS last_close,
  CASE WHEN status IN ('signal', 'below_threshold') THEN {r('rsi', 1)} END AS rsi, d AS days_until_earnings FROM scs"""),
)
def _(spark, sf):
    _, o = screened(spark, sf)
    return tidy(o.select("ticker", "status", "score", "last_close", "rsi", "days_until_earnings"), 3)


@query(
    "scan_counts",
    with_(DAILY, SHORT_ALL, NEXT_EARNINGS, SCREEN, select="SELECT count(*) AS observations_n, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_n" for s in sn.OBSERVATION_STATUSES) + """,
  CASE WHEN bool_or(status IN ('signal', 'below_threshold', 'earnings_excluded')) AND bool_or(status IN ('earnings_failure', 'fetch_failure', 'insufficient_data', 'scoring_failure')) THEN 'partial'
       WHEN bool_or(status IN ('signal', 'below_threshold', 'earnings_excluded')) THEN 'completed' ELSE 'failed' END AS session_status FROM scs"""),
)
def _(spark, sf):
    return sn.scan_counts(screened(spark, sf)[1])


@query(
    "scan_reconciliation",
    with_(DAILY, select="SELECT unnest(['requested_without_row', 'row_without_request', 'ticker_repeated', 'signal_not_in_results', 'result_without_signal']) AS \"check\", 0::BIGINT AS offending"),
)
def _(spark, sf):
    requested, o = screened(spark, sf)
    o = settle(o)
    return sn.reconcile_scan(requested, o, sn.ranked_signals(o).select("ticker", "score"))


# ---- scan history: every daily bar is one scan of a weekly session -------------------------------
SINCE = "2001-01-01"
HISTORY = f"""
pts AS MATERIALIZED (
  SELECT ticker, week AS trading_date, ts AS scan_time, score, close AS last_close, CASE WHEN score >= 40 THEN 'signal' ELSE 'below_threshold' END AS status
  FROM (SELECT *, date_trunc('week', ts)::DATE AS week FROM sc WHERE ts >= TIMESTAMP '{SINCE}') QUALIFY row_number() OVER (PARTITION BY ticker, week ORDER BY ts DESC) = 1),
idx AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_date) - 1 AS i FROM pts),
facts AS MATERIALIZED (
  SELECT ticker, count(*) AS n, count(*) FILTER (score >= 45) AS act, last(score ORDER BY i) AS latest, max(score) AS peak, first(last_close ORDER BY i) AS c0, last(last_close ORDER BY i) AS c1,
    CASE WHEN count(*) >= 2 THEN {rnd_even('(count(*) * sum(i * score) - sum(i) * sum(score))::DOUBLE / (count(*) * sum(i * i) - sum(i) * sum(i))', 2)} ELSE 0 END AS trend,
    datediff('day', first(scan_time ORDER BY i), last(scan_time ORDER BY i)) AS days, string_agg(score::BIGINT::VARCHAR, '|' ORDER BY i) AS hist
  FROM idx GROUP BY ticker),
f2 AS MATERIALIZED (SELECT *, n >= 2 AND abs((c1 - c0) / c0) * 100 >= 3 AS broke FROM facts)"""


def history_points(spark, sf):
    """Scan tables derived from the scored daily bars, read through the latest-per-session rule."""
    scored = owned(add_short_score(with_indicators(src.daily_bars(spark, sf))))
    rows = settle(scored.select("ticker", F.col("ts").alias("scan_time"), "score", F.col("close").alias("last_close"), "pos"))
    obs = rows.select(
        F.concat_ws(":", "ticker", F.col("scan_time").cast("string")).alias("session_id"), F.col("pos").alias("id"), "ticker", "score", "last_close",
        F.when(F.col("score") >= 40, "signal").otherwise("below_threshold").alias("status"),
    )
    sessions = rows.select(
        F.concat_ws(":", "ticker", F.col("scan_time").cast("string")).alias("session_id"), F.lit("short").alias("timeframe"), "scan_time",
        F.to_date(F.date_trunc("week", "scan_time")).alias("trading_date"),
    )
    return hs.daily_scores(obs, sessions, "short", SINCE)


@query("daily_score_history", with_(*SCORED, HISTORY, select=f"SELECT ticker, {day('trading_date')} AS trading_date, {day('scan_time')} AS scan_time, score::BIGINT AS score, {r('last_close', 3)} AS last_close, status FROM pts"))
def _(spark, sf):
    return tidy(history_points(spark, sf), 3)


COIL = rnd_even("least(100e0, latest * 0.4e0 + least(n / 5e0, 1e0) * 20 + act / n::DOUBLE * 20 + greatest(least(trend * 10, 20e0), 0e0))", 1)
FADE = rnd_even("least(100e0, greatest(0e0, peak - latest) * 2 + greatest(0e0, 45 - latest) * 1.5e0 + greatest(0e0, -trend) * 20)", 1)
FADING = "peak >= 45 AND (latest < 45 OR (trend < -0.5 AND latest < peak))"


@query(
    "coil_detector",
    with_(*SCORED, HISTORY, select=f"SELECT ticker, {COIL} AS coil_strength, n AS appearances, act AS active_sessions, latest::DOUBLE AS latest_score, trend AS score_trend, hist AS score_history FROM f2 WHERE n >= 2 AND latest >= 45 AND NOT (abs((c1 - c0) / c0) * 100 >= 2000) AND trend >= -0.5"),
)
def _(spark, sf):
    return tidy(hs.detect_coils(history_points(spark, sf), breakout_pct=2000.0).select("ticker", "coil_strength", "appearances", "active_sessions", "latest_score", "score_trend", "score_history"))


@query(
    "fading_setups",
    with_(*SCORED, HISTORY, select=f"SELECT ticker, {FADE} AS fade_strength, n AS appearances, latest::DOUBLE AS latest_score, peak::DOUBLE AS peak_score, trend AS score_trend, CASE WHEN trend < -0.5 THEN 'fading' WHEN trend < 0.5 THEN 'stable' ELSE 'building' END AS trend_direction FROM f2 WHERE n >= 2 AND {FADING}"),
)
def _(spark, sf):
    return tidy(hs.detect_fading(history_points(spark, sf)).select("ticker", "fade_strength", "appearances", "latest_score", "peak_score", "score_trend", "trend_direction"))


@query(
    "watchlist_states",
    with_(*SCORED, HISTORY, select=f"""
SELECT ticker, CASE WHEN n IS NULL THEN 'no history' WHEN n >= 2 AND latest >= 45 AND NOT broke AND trend > 0.5 THEN 'coiling — building pressure' WHEN n >= 2 AND latest >= 45 AND NOT broke THEN 'coiling — stable'
  WHEN {FADING} THEN 'fading' ELSE 'watching' END AS status, coalesce(n, 0) AS appearances, coalesce(days, 0) AS days_building, coalesce(latest, 0)::DOUBLE AS latest_score, coalesce(trend, 0) AS score_trend
FROM (SELECT DISTINCT p_brand AS ticker FROM part UNION SELECT 'NOSUCH') LEFT JOIN f2 USING (ticker)"""),
)
def _(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    watch = part.select(F.col("p_brand").alias("ticker")).distinct().unionByName(part.select(F.lit("NOSUCH").alias("ticker")).distinct())
    return tidy(hs.ticker_states(watch, history_points(spark, sf)).drop("summary", "peak_score"))


# ---- outcomes ------------------------------------------------------------------------------------
AS_OF = "2001-12-01"
OUTCOME = f"""
nb AS MATERIALIZED (SELECT ticker, ts, CASE WHEN volume::BIGINT % 37 = 5 THEN NULL ELSE close END AS close FROM bars),
sig AS MATERIALIZED (SELECT ticker, ts, pos, score, close AS last_close, CASE pos % 3 WHEN 0 THEN 'intraday' WHEN 1 THEN 'short' ELSE 'long' END AS timeframe, CASE pos % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS n,
  CASE WHEN pos % 5 = 0 THEN NULL ELSE 'p' || (pos % 2) END AS provider FROM sc WHERE score >= 40),
rk AS (SELECT s.*, b.close AS later, row_number() OVER (PARTITION BY s.ticker, s.pos ORDER BY b.ts) AS k
  FROM sig s JOIN nb b ON b.ticker = s.ticker AND b.ts > s.ts AND b.ts <= least(s.ts + to_days(s.n + 7), TIMESTAMP '{AS_OF}')),
out AS MATERIALIZED (
  SELECT s.*, o.later, {rnd_even('later', 4)} AS outcome_close, {rnd_even('(later - s.last_close) / s.last_close * 100', 2)} AS outcome_pct
  FROM sig s LEFT JOIN (SELECT ticker, pos, first(later ORDER BY k) FILTER (k >= n AND later IS NOT NULL) AS later FROM rk GROUP BY 1, 2) o USING (ticker, pos))"""


def outcomes(spark, sf):
    bars = src.daily_bars(spark, sf)
    rows = settle(owned(add_short_score(with_indicators(bars))).select("ticker", "ts", "pos", "score", "close", "volume"))
    tf = F.when(F.col("pos") % 3 == 0, "intraday").when(F.col("pos") % 3 == 1, "short").otherwise("long")
    signals = rows.filter("score >= 40").select(
        F.concat_ws(":", "ticker", "pos").alias("id"), "ticker", "pos", F.col("ts").alias("scan_time"), "score", F.col("close").alias("last_close"), tf.alias("timeframe"),
        F.when(F.col("pos") % 5 != 0, F.concat(F.lit("p"), F.col("pos") % 2)).alias("provider"),
    )
    daily = rows.select("ticker", "ts", F.when(F.col("volume").cast("bigint") % 37 != 5, F.col("close")).alias("close"))
    return hs.resolve_outcomes(signals, daily, AS_OF).withColumn("outcome_provider", F.lit("p0"))


@query("outcome_pass", with_(*SCORED, OUTCOME, select=f"SELECT ticker, pos, timeframe, CASE WHEN later IS NULL THEN 'pending' ELSE 'resolved' END AS outcome_status, {r('outcome_close', 3)} AS outcome_close, {r('outcome_pct', 2)} AS outcome_pct FROM out"))
def _(spark, sf):
    return tidy(outcomes(spark, sf).select("ticker", "pos", "timeframe", "outcome_status", "outcome_close", "outcome_pct"), 3)


@query(
    "outcome_stats",
    with_(*SCORED, OUTCOME, select=f"""
SELECT timeframe, CASE WHEN score >= 80 THEN '80-100' WHEN score >= 60 THEN '60-79' WHEN score >= 40 THEN '40-59' ELSE '<40' END AS score_bucket, count(*) AS total, {r('avg(outcome_pct)', 1)} AS avg_return_pct,
  {r('avg((outcome_pct > 0)::INT) * 100', 1)} AS win_rate_pct, {r('max(outcome_pct)', 2)} AS best, {r('min(outcome_pct)', 2)} AS worst FROM out WHERE later IS NOT NULL GROUP BY 1, 2"""),
)
def _(spark, sf):
    s = settle(hs.outcome_stats(outcomes(spark, sf)))
    return tidy(s.select("timeframe", "score_bucket", "total", "avg_return_pct", "win_rate_pct"), 1).join(tidy(s.select("timeframe", "score_bucket", "best", "worst"), 2), ["timeframe", "score_bucket"])


@query(
    "journal_kpis",
    with_(*SCORED, OUTCOME, select=f"""
SELECT count(*) AS total, count(*) FILTER (outcome_pct > 0) AS wins, count(*) FILTER (outcome_pct <= 0) AS losses, {r('avg(outcome_pct) FILTER (outcome_pct > 0)', 3)} AS avg_win, {r('avg(outcome_pct) FILTER (outcome_pct <= 0)', 3)} AS avg_loss,
  count(*) FILTER (provider IS NOT NULL AND provider <> 'p0') AS provider_mismatches, {r('avg((outcome_pct > 0)::INT) * 100', 3)} AS win_rate_pct, {r('avg(outcome_pct)', 3)} AS expectancy
FROM out WHERE later IS NOT NULL AND score >= 60"""),
)
def _(spark, sf):
    return tidy(hs.journal_kpis(hs.journal(outcomes(spark, sf), None, 60)), 3)


@query(
    "outcome_histogram",
    with_(*SCORED, OUTCOME, select="""
SELECT least(floor((outcome_pct - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS count
FROM out CROSS JOIN (SELECT min(outcome_pct) AS lo, max(outcome_pct) AS hi FROM out) WHERE outcome_pct IS NOT NULL GROUP BY 1"""),
)
def _(spark, sf):
    return tidy(hs.histogram(settle(outcomes(spark, sf).select("outcome_pct")), "outcome_pct", 30))


@query(
    "recent_appearances",
    with_(*SCORED, select=f"SELECT ticker, count(*) AS appearances, max(score)::BIGINT AS peak_score, {r('avg(score)')} AS avg_score, {day('max(ts)')} AS last_seen, {day('min(ts)')} AS first_seen FROM sc WHERE score >= 40 AND ts >= TIMESTAMP '{SINCE}' GROUP BY 1"),
)
def _(spark, sf):
    rows = owned(add_short_score(with_indicators(src.daily_bars(spark, sf)))).filter("score >= 40")
    signals = rows.select("ticker", F.lit("short").alias("timeframe"), F.col("ts").alias("scan_time"), "score")
    return tidy(hs.recent_appearances(signals, "short", SINCE))


@query(
    "recent_scan_runs",
    with_(select=f"""
SELECT {day('o_orderdate')} AS run_time, count(*) AS tickers_n, count(*) FILTER (o_orderstatus = 'F') AS hits_n, CASE WHEN count(*) > 5 THEN {r("100e0 * count(*) FILTER (o_orderstatus = 'F') / count(*)")} END AS hit_rate_pct
FROM orders GROUP BY o_orderdate ORDER BY o_orderdate DESC LIMIT 20""", recursive=True).replace("WITH RECURSIVE \n", ""),
)
def _(spark, sf):
    # one run per order day; the report is the newest twenty
    runs = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderdate").cast("timestamp").alias("run_time")).agg(
        F.count(F.lit(1)).alias("tickers_n"), F.count_if(F.col("o_orderstatus") == "F").alias("hits_n")
    ).withColumn("id", F.unix_seconds("run_time")).withColumn("counts_complete", F.col("tickers_n") > 5)
    return tidy(hs.recent_runs(runs, 20).select("run_time", "tickers_n", "hits_n", "hit_rate_pct"))


# ---- context -------------------------------------------------------------------------------------
REGIME = f"""
{MARKET}, mb AS (SELECT 'MARKET' AS ticker, * FROM mk), {numbered('mb', 'mbn')}, {indicators('mbn', 'mi')},
reg AS MATERIALIZED (
  SELECT *, ema_20 - lag(ema_20, 5) OVER (ORDER BY pos) AS slope FROM mi),
regime AS MATERIALIZED (
  SELECT ts, close, CASE WHEN ema_50 IS NOT NULL AND slope IS NOT NULL THEN close > ema_20 AND ema_20 > ema_50 AND slope > 0 END AS bullish FROM reg),
rat AS MATERIALIZED (
  SELECT b.ticker, b.ts, b.close / m.close AS x, row_number() OVER (PARTITION BY b.ticker ORDER BY b.ts) - 1 AS p FROM bars b JOIN mk m ON m.ts = b.ts),
rsr AS (
  SELECT ticker, p, x AS e FROM rat WHERE p = 0
  UNION ALL SELECT n.ticker, n.p, n.x * (2e0/21) + r.e * (19e0/21) FROM rsr r JOIN rat n ON n.ticker = r.ticker AND n.p = r.p + 1),
rs AS MATERIALIZED (
  SELECT a.ticker, a.ts, a.x AS ratio, CASE WHEN a.p >= 19 THEN e END AS ema, a.x / lag(a.x, 20) OVER (PARTITION BY a.ticker ORDER BY a.p) - 1 AS chg,
    CASE WHEN a.p >= 20 THEN a.x > e AND a.x / lag(a.x, 20) OVER (PARTITION BY a.ticker ORDER BY a.p) - 1 > 0 END AS pos_rs
  FROM rat a JOIN rsr USING (ticker, p))"""


def market_parts(spark, sf):
    """Bars of the tickers and of the market, made from the lines once, whatever a study reads them for, and each ticker's proxy."""
    bars = settle(src.daily_bars(spark, sf))
    proxies = settle(src.market_bars(spark, sf))
    mapping = bars.select("ticker").distinct().withColumn("proxy", F.lit("MARKET"))
    return bars, proxies, mapping


@query("market_regime", with_(DAILY, REGIME, select=f"SELECT {day('ts')} AS ts, {r('close', 3)} AS close, bullish AS regime_bullish FROM regime"))
def _(spark, sf):
    return tidy(cx.regimes(src.market_bars(spark, sf)).select("ts", "close", "regime_bullish"), 3)


@query("relative_strength", with_(DAILY, REGIME, select=f"SELECT ticker, {day('ts')} AS ts, {r('ratio')} AS rs_ratio, {r('ema')} AS rs_ema20, {r('chg')} AS rs_change_20_pct, pos_rs AS rs_positive FROM rs"))
def _(spark, sf):
    bars, proxies, mapping = market_parts(spark, sf)
    return tidy(cx.relative_strength(bars, proxies, mapping).drop("proxy"))


CONTEXT = """
sg AS MATERIALIZED (SELECT ticker, ts + INTERVAL 30 HOUR AS ts, score FROM sc WHERE score >= 40),
c1 AS (SELECT g.*, m.ts AS ct, m.bullish FROM sg g ASOF LEFT JOIN regime m ON g.ts >= m.ts),
c2 AS (SELECT c.*, (SELECT count(*) FROM (SELECT unnest(generate_series(ct::DATE, ts::DATE, INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6) <= 2 AS fresh FROM c1 c),
ctx AS MATERIALIZED (
  SELECT c2.ticker, c2.ts, c2.score, c2.ct, CASE WHEN ct IS NULL THEN 'no_data' WHEN fresh THEN 'ok' ELSE 'stale' END AS status, CASE WHEN fresh THEN bullish END AS bullish, CASE WHEN fresh THEN s.pos_rs END AS pos_rs
  FROM c2 ASOF LEFT JOIN rs s ON c2.ticker = s.ticker AND c2.ct >= s.ts)"""


def signal_context(spark, sf):
    bars, proxies, mapping = market_parts(spark, sf)
    scored = owned(add_short_score(with_indicators(bars))).filter("score >= 40")
    signals = scored.select("ticker", (F.col("ts") + F.expr("INTERVAL 30 HOURS")).alias("ts"), "score").withColumn("proxy", F.lit("MARKET"))
    market = cx.regimes(proxies).withColumnRenamed("ticker", "proxy")
    strength = cx.relative_strength(bars, proxies, mapping)
    return cx.context_for_signals(settle(signals), settle(market.select("proxy", "ts", "regime_bullish")), settle(strength), "market")


@query(
    "signal_market_context",
    with_(*SCORED, REGIME, CONTEXT, select=f"""
SELECT ticker, {day('ts')} AS ts, score::BIGINT AS score, {day('ct')} AS market_context_time, status AS market_status, bullish AS market_regime_bullish, pos_rs AS market_rs_positive,
  coalesce(bullish AND pos_rs, false) AS eligible, CASE WHEN bullish IS NULL OR pos_rs IS NULL THEN CASE WHEN bullish IS NULL THEN 'unavailable' ELSE 'unavailable' END WHEN bullish AND pos_rs THEN 'eligible' ELSE 'filtered' END AS context_status FROM ctx"""),
)
def _(spark, sf):
    c = signal_context(spark, sf)
    ok, status, _ = cx.eligibility("market_rs")
    return tidy(c.withColumn("eligible", ok).withColumn("context_status", status).select("ticker", "ts", "score", "market_context_time", "market_status", "market_regime_bullish", "market_rs_positive", "eligible", "context_status"))


@query(
    "close_on_or_before",
    with_(DAILY, select=f"""
SELECT ticker, {day('d')} AS decision_date, CASE WHEN datediff('day', b.ts, d) <= 5 THEN {day('b.ts')} END AS close_date, CASE WHEN datediff('day', b.ts, d) <= 5 THEN {r('b.close', 3)} END AS close
FROM (SELECT DISTINCT ticker, last_day(ts)::TIMESTAMP AS d FROM bars) m ASOF LEFT JOIN bars b USING (ticker) WHERE true""".replace("ASOF LEFT JOIN bars b USING (ticker) WHERE true", "ASOF LEFT JOIN (SELECT ticker AS t2, ts, close FROM bars) b ON m.ticker = b.t2 AND m.d >= b.ts")),
)
def _(spark, sf):
    bars = src.daily_bars(spark, sf)
    decisions = bars.select("ticker", F.last_day("ts").alias("decision_date")).distinct()
    return tidy(cx.close_on_or_before(decisions, bars), 3)


@query(
    "policy_metrics",
    with_(*SCORED, REGIME, CONTEXT, f"""
pe AS MATERIALIZED (
  SELECT c.*, {split_sql('c.ts')} AS split, (x.close / n.open - 1) * 100 AS net FROM ctx c JOIN b n ON n.ticker = c.ticker AND n.ts = (SELECT min(ts) FROM b z WHERE z.ticker = c.ticker AND z.ts > c.ts - INTERVAL 30 HOUR)
  JOIN b x ON x.ticker = n.ticker AND x.pos = n.pos + 2 WHERE {split_sql('c.ts')} IS NOT NULL),
pp AS (SELECT *, 'off' AS policy, true AS kept FROM pe UNION ALL SELECT *, 'market_rs', coalesce(bullish AND pos_rs, false) FROM pe),
pk AS (SELECT split, policy, ticker, count(*) AS a, count(*) FILTER (kept) AS k, avg(net) FILTER (kept) AS m, sum(net) FILTER (kept) AS s, count(*) FILTER (kept AND net > 0) AS p FROM pp GROUP BY ALL)""",
        select=f"""
SELECT split, policy, sum(k)::BIGINT AS eligible_events, count(*) FILTER (k > 0) AS tickers, {r('sum(k) / sum(a) * 100')} AS event_retention_pct, {r('avg((k > 0)::INT) * 100')} AS ticker_coverage_pct, {r('sum(s) / sum(k)', 3)} AS mean_net_return_pct,
  {r('sum(p) / sum(k) * 100', 3)} AS positive_rate_pct, {r('avg(m)', 3)} AS mean_ticker_return_pct, {r('median(m)', 3)} AS median_ticker_return_pct, {r('(SELECT median(net) FROM pp WHERE kept AND pp.split = pk.split AND pp.policy = pk.policy)', 3)} AS median_net_return_pct FROM pk GROUP BY 1, 2"""),
)
def _(spark, sf):
    from barloom.operators.blocks import block_window
    from barloom.operators.calendar import in_split
    c = settle(signal_context(spark, sf)).withColumn("bar_ts", F.col("ts") - F.expr("INTERVAL 30 HOURS"))
    w = block_window(["ticker"])
    ahead = owned(with_indicators(src.daily_bars(spark, sf), ("ticker",), 4).withColumns({"o1": F.lead("open", 1).over(w), "c3": F.lead("close", 3).over(w)}))
    events = c.join(ahead.select("ticker", F.col("ts").alias("bar_ts"), ((F.col("c3") / F.col("o1") - 1) * 100).alias("net")), ["ticker", "bar_ts"])
    events = events.withColumn("split", in_split(F.to_date("ts"), SPLITS)).filter("split IS NOT NULL AND net IS NOT NULL")
    ok, _, _ = cx.eligibility("market_rs")
    m = cx.policy_metrics(events, {"off": F.lit(True), "market_rs": ok}, "net")
    a = tidy(m.select("split", "policy", "eligible_events", "event_retention_pct", "ticker_coverage_pct"))
    return a.join(tidy(m.drop("eligible_events", "event_retention_pct", "ticker_coverage_pct"), 3), ["split", "policy"])
