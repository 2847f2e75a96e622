"""Intraday session study and weekly study."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.config import Split
from barloom.operators import calendar as cal
from barloom.plans import intraday as it
from barloom.plans import session_study as ss
from barloom.plans import weekly as wk
from barloom.session import settle
from barloom.sources import bars as src
from oracle.sql import DAILY, MARKET, bootstrap, day, event_bars, indicators, minute, numbered, r, with_

from .base import query, tidy
from .bars import EXPANDING, INTRADAY_SCORE, LONG_SCORE, WEEKLY, weekly
from .market import LOCAL, SESSIONS, event_calendar
from .studies import SPLITS, split_sql

# sessions of the test stream hold six 65-minute bars
SPEC = it.SessionSpec(bar_minutes=65, drive_bars=2, prior_sessions=3, min_return_pct=0.75, min_volume_multiple=0.8, window_start=635, window_end=895, time_exit=960, prior_close_min=0.5, prior_dollar_volume_min=10.0)
COSTS = [("base", 5.0), ("stress", 10.0)]

# 65-minute bars aligned to the session open of each day
GRIDDED = f"""
ev AS MATERIALIZED (SELECT event_type AS ticker, event_id, value, ts, {LOCAL} AS lt FROM events),
bars AS MATERIALIZED (
  SELECT ticker, lt::DATE AS ld, floor((epoch(lt) - epoch(lt::DATE::TIMESTAMP) - 34200) / 3900)::BIGINT AS slot,
    lt::DATE + INTERVAL 570 MINUTE + to_minutes(floor((epoch(lt) - epoch(lt::DATE::TIMESTAMP) - 34200) / 3900)::BIGINT * 65) AS lts,
    first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM ev GROUP BY 1, 2, 3, 4),
dayspan AS MATERIALIZED (SELECT unnest(generate_series((SELECT min(lts) FROM bars)::DATE, (SELECT max(lts) FROM bars)::DATE, INTERVAL 1 DAY))::DATE AS d),
sess AS MATERIALIZED (SELECT d FROM dayspan WHERE isodow(d) < 6 AND day(d) <> 24),
sb AS MATERIALIZED (
  SELECT ticker, d, slot, open, high, low, close, volume, lts,
    sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w AS vwap
  FROM bars JOIN sess ON d = ld WHERE slot BETWEEN 0 AND 5 WINDOW w AS (PARTITION BY ticker, d ORDER BY slot))"""


def session_data(spark, sf):
    """Bars of 65 minutes counted from the local session open."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type", "value")
    t = F.col("ts").cast("timestamp")
    local = F.from_utc_timestamp(t, cal.ZONE)
    midnight = F.to_date(local)
    seconds = F.unix_micros(local) / 1e6 - F.unix_seconds(midnight.cast("timestamp"))
    slot = F.floor((seconds - 34_200) / 3_900)
    ticks = ev.select(
        F.col("event_type").alias("ticker"), cal.at_local(midnight, 570 + slot * 65).alias("bar_ts"), F.unix_micros(t).alias("us"), "event_id",
        F.col("value").alias("price"), F.lit(1.0).alias("quantity"), local.alias("lt"), midnight.alias("ld"), slot.alias("slot"),
    )
    order = src.wide_order(F.col("us") - F.unix_micros("bar_ts"), F.col("event_id"))
    bars = src.ticks_to_bars(ticks, ["ticker", "bar_ts"], order).withColumnRenamed("bar_ts", "ts")
    sessions = cal.calendar_of(src.event_bars(spark, sf, 60), early_close=F.dayofmonth("session_date") == 24)
    grid = cal.session_grid(sessions, 65)
    return bars, sessions, grid, it.with_vwap(it.session_bars(bars, sessions, grid))


@query("session_vwap", with_(GRIDDED, select=f"SELECT ticker, {day('d')} AS session_date, slot AS grid_idx, {r('close')} AS close, {r('vwap')} AS vwap FROM sb"))
def _(spark, sf):
    _, _, _, b = session_data(spark, sf)
    return tidy(b.select("ticker", "session_date", "grid_idx", "close", "vwap"))


@query(
    "session_quality",
    with_(GRIDDED, select="""
SELECT ticker, count(*) AS total_rows, 0::BIGINT AS duplicate_timestamps, count(*) FILTER (NOT (slot BETWEEN 0 AND 5 AND ld IN (SELECT d FROM sess))) AS off_grid_bars, 0::BIGINT AS invalid_ohlc_rows, 0::BIGINT AS zero_volume_bars,
  count(*) FILTER (slot BETWEEN 0 AND 5 AND ld IN (SELECT d FROM sess)) AS valid_bars, count(DISTINCT ld) FILTER (ld IN (SELECT d FROM sess)) AS sessions,
  6 * count(DISTINCT ld) FILTER (ld IN (SELECT d FROM sess)) - count(*) FILTER (slot BETWEEN 0 AND 5 AND ld IN (SELECT d FROM sess)) AS missing_bars,
  (6 * count(DISTINCT ld) FILTER (ld IN (SELECT d FROM sess)) - count(*) FILTER (slot BETWEEN 0 AND 5 AND ld IN (SELECT d FROM sess))) / (6e0 * count(DISTINCT ld) FILTER (ld IN (SELECT d FROM sess))) <= 0.05 AS sufficient
FROM bars GROUP BY ticker"""),
)
def _(spark, sf):
    bars, sessions, grid, b = session_data(spark, sf)
    q = it.session_quality(bars, sessions, grid, b).withColumn("sufficient", F.size(it.sufficiency_reasons()) == 0)
    return tidy(q.drop("bars_per_session"))


DRIVE = """
dr0 AS MATERIALIZED (
  SELECT ticker, d, count(*) FILTER (slot < 2) AS early, count(*) = 6 AS complete, max(open) FILTER (slot = 0) AS o0, max(close) FILTER (slot = 1) AS c1, max(vwap) FILTER (slot = 1) AS v1, sum(volume) FILTER (slot < 2) AS cv
  FROM sb GROUP BY 1, 2),
dr1 AS (SELECT *, sum(complete::INT) OVER (PARTITION BY ticker ORDER BY d) - complete::INT AS before, sum(complete::INT) OVER (PARTITION BY ticker ORDER BY d) AS nth FROM dr0),
dr2 AS MATERIALIZED (SELECT a.*, (SELECT CASE WHEN count(*) = 3 THEN median(cv) END FROM dr1 p WHERE p.ticker = a.ticker AND p.complete AND p.nth BETWEEN a.before - 2 AND a.before) AS med FROM dr1 a),
drv AS MATERIALIZED (
  SELECT *, CASE WHEN early = 2 THEN 100e0 * (c1 / o0 - 1) END AS ret, CASE WHEN med > 0 THEN cv / med END AS mult,
    coalesce(early = 2 AND 100e0 * (c1 / o0 - 1) >= 0.75 AND c1 > v1 AND med > 0 AND cv / med >= 0.8, false) AS qualified FROM dr2)"""


@query("opening_drive", with_(GRIDDED, DRIVE, select=f"SELECT ticker, {day('d')} AS session_date, qualified, {r('ret', 3)} AS return_pct, {r('v1')} AS vwap_at_decision, {r('cv')} AS cumulative_volume, {r('med')} AS median_prior_volume, {r('mult')} AS volume_multiple, (2 - early)::BIGINT AS missing_bars, complete FROM drv"))
def _(spark, sf):
    _, _, grid, b = session_data(spark, sf)
    d = it.opening_drives(settle(b), grid, SPEC)
    keys = ["ticker", "session_date"]
    return tidy(d.select(*keys, "qualified", "vwap_at_decision", "cumulative_volume", "median_prior_volume", "volume_multiple", "missing_bars", "complete")).join(tidy(d.select(*keys, "return_pct"), 3), keys)


TRADES = """
rc AS MATERIALIZED (
  SELECT ticker, d, s.strategy, sb.slot AS si, low - greatest(0.01e0, close * 0.0005e0) AS stop
  FROM sb JOIN drv USING (ticker, d) CROSS JOIN (SELECT unnest(['candidate', 'baseline_b']) AS strategy) s
  WHERE slot BETWEEN 1 AND 4 AND low <= vwap AND close > vwap AND close > open AND close >= (SELECT max(z.open) FROM sb z WHERE z.ticker = sb.ticker AND z.d = sb.d AND z.slot = 0) AND (s.strategy = 'baseline_b' OR qualified)
  QUALIFY row_number() OVER (PARTITION BY ticker, d, s.strategy ORDER BY slot) = 1),
en AS MATERIALIZED (
  SELECT rc.*, scenario, bps, e.open AS eo, e.open * (1 + bps / 1e4) AS fill, e.open * (1 + bps / 1e4) - stop AS risk,
    CASE WHEN e.open IS NULL THEN 'rejected_no_next_bar' WHEN e.open <= stop THEN 'rejected_entry_at_or_below_stop' WHEN e.open * (1 + bps / 1e4) - stop <= 0 THEN 'rejected_nonpositive_risk' ELSE 'executed' END AS status
  FROM rc CROSS JOIN (VALUES ('base', 5e0), ('stress', 10e0)) c(scenario, bps) LEFT JOIN sb e ON e.ticker = rc.ticker AND e.d = rc.d AND e.slot = si + 1),
px AS (
  SELECT en.*, b.slot, fill + 1.5e0 * risk AS target, CASE WHEN b.open <= stop THEN 'gap_stop' WHEN b.open >= fill + 1.5e0 * risk THEN 'gap_target' WHEN b.low <= stop THEN 'stop' WHEN b.high >= fill + 1.5e0 * risk THEN 'target' WHEN b.slot = 5 THEN 'time' END AS reason,
    b.open AS bo, b.close AS bc FROM en JOIN sb b ON b.ticker = en.ticker AND b.d = en.d AND b.slot > si WHERE status = 'executed'),
xt AS MATERIALIZED (
  SELECT ticker, d, strategy, scenario, arg_min(slot, slot) FILTER (reason IS NOT NULL) AS xs, arg_min(reason, slot) FILTER (reason IS NOT NULL) AS reason,
    arg_min(CASE WHEN reason LIKE 'gap%' THEN bo WHEN reason = 'stop' THEN stop WHEN reason = 'target' THEN target ELSE bc END, slot) FILTER (reason IS NOT NULL) AS xp, max(slot) AS fs, arg_max(bc, slot) AS fp FROM px GROUP BY 1, 2, 3, 4),
tr AS MATERIALIZED (
  SELECT en.ticker, en.d, en.strategy, en.scenario, si, status, eo, stop, CASE WHEN status = 'executed' THEN coalesce(reason, 'time_fallback') END AS exit_type, coalesce(xp, fp) AS raw,
    CASE WHEN status = 'executed' THEN (coalesce(xp, fp) * (1 - bps / 1e4) - fill) / risk END AS net_r, CASE WHEN status = 'executed' THEN greatest(0e0, (coalesce(xs, fs) - (si + 1) + CASE WHEN reason LIKE 'gap%' THEN 0 ELSE 1 END) * 65e0) END AS hold
  FROM en LEFT JOIN xt USING (ticker, d, strategy, scenario))"""


META = """
meta AS MATERIALIZED (
  SELECT ticker, arg_min(close, lts) AS prior_close, (SELECT median(x) FROM (SELECT sum(close * volume) AS x FROM sb z WHERE z.ticker = sb.ticker GROUP BY d)) AS mdv,
    CASE WHEN ticker = 'error' THEN 'warrant' WHEN ticker IN ('click', 'view') THEN 'etf' ELSE 'common_stock' END AS security_type, ticker IN ('click', 'view') AS is_etf, ticker <> 'none' AS is_eligible FROM sb GROUP BY 1),
elig AS MATERIALIZED (
  SELECT *, array_to_string(list_filter([CASE WHEN NOT is_eligible THEN 'ticker_not_eligible' END, CASE WHEN prior_close < 0.5 THEN 'prior_close_below_min' END,
    CASE WHEN mdv < 10 THEN 'prior_20_median_dollar_volume_below_threshold' END, CASE WHEN security_type IN ('otc', 'warrant', 'right', 'unit', 'preferred_stock') THEN 'security_type_excluded_' || security_type END], lambda x: x IS NOT NULL), ';') AS why FROM meta)"""
BASELINE_A = ["sbs AS (SELECT ticker, lts AS ts, d, slot, open, high, low, close, volume FROM sb)", numbered("sbs"), indicators(), """
ba AS MATERIALIZED (
  SELECT i.*, lag(macd_diff) OVER (PARTITION BY ticker ORDER BY pos) AS pd,
    CASE WHEN bb_width IS NOT NULL THEN
    ((SELECT count(*) FROM ind j WHERE j.ticker = i.ticker AND j.pos <= i.pos AND j.bb_width < i.bb_width)
     + ((SELECT count(*) FROM ind j WHERE j.ticker = i.ticker AND j.pos <= i.pos AND j.bb_width = i.bb_width) + 1) / 2e0)
    / (SELECT count(bb_width) FROM ind j WHERE j.ticker = i.ticker AND j.pos <= i.pos) END AS wr
  FROM ind i)""", f"""
basig AS MATERIALIZED (
  SELECT ticker, d, slot AS si, {INTRADAY_SCORE} AS score, wr, low - greatest(0.01e0, close * 0.0005e0) AS stop FROM ba
  WHERE 570 + (slot + 1) * 65 BETWEEN 635 AND 895 AND pos >= 20 AND {INTRADAY_SCORE} >= 40 QUALIFY row_number() OVER (PARTITION BY ticker, d ORDER BY slot) = 1)"""]
RECLAIMS, ATTEMPTS = TRADES.split("en AS MATERIALIZED (", 1)
STUDY = [
    GRIDDED, DRIVE, META, *BASELINE_A, RECLAIMS.replace("rc AS MATERIALIZED (", "rc0 AS MATERIALIZED (", 1).rstrip().rstrip(","), """
rc AS MATERIALIZED (
  SELECT ticker, d, strategy, si, stop FROM rc0 WHERE ticker IN (SELECT ticker FROM elig WHERE why = '')
  UNION ALL SELECT ticker, d, 'baseline_a', si, stop FROM basig WHERE ticker IN (SELECT ticker FROM elig WHERE why = ''))""", "en AS MATERIALIZED (" + ATTEMPTS, """
hist AS (SELECT ticker, d, sum(count(*)) OVER (PARTITION BY ticker ORDER BY d) AS h, max(open) FILTER (slot = 0) AS o FROM sb GROUP BY 1, 2),
sg AS MATERIALIZED (
  SELECT h.ticker, h.d, s.strategy, c.scenario, e.is_etf, coalesce(t.status, 'no_signal') AS status, t.si, t.exit_type, t.net_r, t.hold, CASE WHEN s.strategy = 'baseline_a' AND t.status IS NOT NULL THEN b.score END AS score,
    CASE WHEN t.status = 'rejected_no_next_bar' THEN 'next_expected_bar_missing_or_invalid' WHEN t.status = 'rejected_entry_at_or_below_stop' THEN 'next_bar_open_at_or_below_stop'
      WHEN t.status = 'rejected_nonpositive_risk' THEN 'nonpositive_or_nonfinite_risk_per_share' WHEN t.status = 'executed' THEN NULL WHEN e.why <> '' THEN e.why WHEN s.strategy <> 'baseline_a' THEN 'no_reclaim_bar_found'
      WHEN h.h < 20 THEN 'insufficient_history_for_indicators' ELSE 'no_score_reached_40' END AS reason,
    CASE WHEN s.strategy = 'candidate' AND e.why = '' THEN v.qualified END AS drive, CASE WHEN t.status = 'executed' THEN (h.o - e.prior_close) / e.prior_close END AS gap, CASE WHEN t.status = 'executed' THEN strftime(h.d, '%Y-%m') ELSE 'unknown' END AS month
  FROM hist h CROSS JOIN (SELECT unnest(['candidate', 'baseline_a', 'baseline_b']) AS strategy) s CROSS JOIN (SELECT unnest(['base', 'stress']) AS scenario) c JOIN elig e ON e.ticker = h.ticker
  LEFT JOIN tr t ON t.ticker = h.ticker AND t.d = h.d AND t.strategy = s.strategy AND t.scenario = c.scenario LEFT JOIN basig b ON b.ticker = h.ticker AND b.d = h.d LEFT JOIN drv v ON v.ticker = h.ticker AND v.d = h.d)""",
]
METRICS = """
gp AS MATERIALIZED (
  SELECT *, 'all' AS grouping, 'all' AS member FROM sg UNION ALL SELECT *, 'month', month FROM sg WHERE scenario = 'base'
  UNION ALL SELECT *, 'gap', CASE WHEN gap IS NULL THEN 'unknown' WHEN gap < -0.01 THEN 'below_minus_1pct' WHEN gap < 0 THEN 'minus_1pct_to_0' WHEN gap = 0 THEN 'zero' WHEN gap <= 0.01 THEN '0_to_plus_1pct' ELSE 'above_plus_1pct' END FROM sg WHERE scenario = 'base'),
ex AS MATERIALIZED (SELECT *, 100 + sum(net_r) OVER (PARTITION BY strategy, scenario, grouping, member, ticker ORDER BY d) AS eq, 100 + sum(net_r) OVER (PARTITION BY strategy, scenario, grouping, member ORDER BY d, si, ticker) AS aeq FROM gp WHERE status = 'executed'),
ep AS (SELECT *, greatest(100, max(eq) OVER (PARTITION BY strategy, scenario, grouping, member, ticker ORDER BY d)) AS pk, greatest(100, max(aeq) OVER (PARTITION BY strategy, scenario, grouping, member ORDER BY d, si, ticker)) AS apk FROM ex),
sy0 AS (SELECT strategy, scenario, grouping, member, ticker, any_value(is_etf) AS is_etf, count(*) AS n, sum(net_r) AS total, avg(net_r) AS mean, coalesce(sum(net_r) FILTER (net_r > 0), 0) AS gp, coalesce(sum(net_r) FILTER (net_r < 0), 0) AS gl, min(least(0, 100 * (eq - pk) / pk)) AS dd FROM ep GROUP BY ALL),
sy AS MATERIALIZED (SELECT *, CASE WHEN gp = 0 AND gl = 0 THEN 'break_even' WHEN gp = 0 THEN 'no_profit' WHEN gl = 0 THEN 'no_loss_positive' ELSE 'finite' END AS pc, CASE WHEN gp > 0 AND gl = 0 THEN NULL WHEN gp = 0 THEN 0 ELSE gp / -gl END AS pf FROM sy0),
sm AS (
  SELECT strategy, scenario, grouping, member, count(*) AS represented_symbols, count(*) FILTER (NOT is_etf) AS represented_stock_symbols, count(*) FILTER (is_etf) AS represented_etf_symbols, median(mean) AS median_per_symbol_expectancy, avg(mean) AS equal_weighted_per_symbol_mean_expectancy,
    avg((mean > 0)::INT) AS positive_symbol_rate, median(total) AS median_per_symbol_total_return, median(dd) AS median_per_symbol_maximum_drawdown_pct, list_sort(list(coalesce(pf, 1e300))) AS pfs, max(n) AS most, max(total) FILTER (total > 0) AS best,
    max(-total) FILTER (total < 0) AS worst, sum(-total) FILTER (total < 0) AS losses FROM sy GROUP BY ALL),
sp AS (
  SELECT strategy, scenario, grouping, member, count(*) AS total_trades, sum(net_r) AS pooled_total_return, count(*) FILTER (NOT is_etf) AS stock_n, count(*) FILTER (is_etf) AS etf_n, coalesce(avg(net_r) FILTER (NOT is_etf), 0) AS stock_e, coalesce(avg(net_r) FILTER (is_etf), 0) AS etf_e,
    min(least(0, 100 * (aeq - apk) / apk)) AS mdd FROM ep GROUP BY ALL),
sc AS (
  SELECT strategy, scenario, grouping, member, count(*) AS total_signals, count(*) FILTER (status = 'executed') AS executed_trades, count(*) FILTER (status LIKE 'rejected%') AS rejected_signals, count(*) FILTER (status = 'no_signal') AS no_signal_count,
    count(*) FILTER (status = 'rejected_no_next_bar') AS rejected_no_next_bar, count(*) FILTER (status = 'rejected_entry_at_or_below_stop') AS rejected_entry_at_or_below_stop, count(*) FILTER (status = 'rejected_nonpositive_risk') AS rejected_nonpositive_risk,
    EXITS, avg((net_r > 0)::INT) FILTER (status = 'executed') AS positive_trade_rate, avg(hold) FILTER (status = 'executed') AS average_holding_minutes FROM gp GROUP BY ALL),
mt AS MATERIALIZED (
  SELECT sc.*, coalesce(total_trades, 0) AS total_trades, coalesce(pooled_total_return, 0) AS pooled_total_return, coalesce(pooled_total_return / total_trades, 0) AS pooled_expectancy, coalesce(mdd, 0) AS overall_maximum_drawdown_pct, coalesce(stock_n, 0) AS stock_stratum_trade_count, coalesce(etf_n, 0) AS etf_stratum_trade_count,
    coalesce(stock_e, 0) AS stock_stratum_pooled_expectancy, coalesce(etf_e, 0) AS etf_stratum_pooled_expectancy, coalesce(represented_symbols, 0) AS represented_symbols, coalesce(represented_stock_symbols, 0) AS represented_stock_symbols, coalesce(represented_etf_symbols, 0) AS represented_etf_symbols,
    median_per_symbol_expectancy, equal_weighted_per_symbol_mean_expectancy, positive_symbol_rate, median_per_symbol_total_return, median_per_symbol_maximum_drawdown_pct, coalesce(most / total_trades, 0) AS trade_count_concentration,
    (pfs[(len(pfs) + 1) // 2] + pfs[len(pfs) // 2 + 1]) / 2 AS pfo, CASE WHEN pooled_total_return > 0 THEN best / pooled_total_return END AS net_profit_concentration, CASE WHEN pooled_total_return <= 0 THEN worst / losses END AS absolute_loss_concentration
  FROM sc LEFT JOIN sp USING (strategy, scenario, grouping, member) LEFT JOIN sm USING (strategy, scenario, grouping, member))""".replace("EXITS", ", ".join(f"count(*) FILTER (exit_type = '{t}') AS exit_{t}" for t in ss.EXITS))


def session_meta(b):
    """What is known of a ticker, derived from its bars."""
    daily = b.groupBy("ticker", "session_date").agg(F.sum(F.col("close") * F.col("volume")).alias("x")).groupBy("ticker").agg(F.percentile("x", 0.5).alias("median_dollar_volume"))
    first = b.groupBy("ticker").agg(F.min_by("close", "bar_start").alias("prior_close"))
    etf = F.col("ticker").isin("click", "view")
    kind = F.when(F.col("ticker") == "error", "warrant").when(etf, "etf").otherwise("common_stock")
    return first.join(daily, "ticker").select("ticker", "prior_close", "median_dollar_volume", kind.alias("security_type"), etf.alias("is_etf"), (F.col("ticker") != "none").alias("is_eligible"))


def session_signals(spark, sf):
    bars, sessions, grid, b = session_data(spark, sf)
    b = settle(b)
    drives = settle(it.opening_drives(b, grid, SPEC))
    return settle(ss.session_signals(b, drives, grid, settle(session_meta(b)), COSTS, SPEC)), (bars, sessions, grid, b)


def session_metrics(spark, sf):
    signals, data = session_signals(spark, sf)
    groups = settle(ss.grouped(signals, "base"))
    trades = settle(ss.finite_trades(groups))
    symbols = settle(ss.per_symbol_metrics(trades, ss.CELL))
    return settle(ss.study_metrics(groups, symbols, trades)), symbols, data


@query("session_eligibility", with_(GRIDDED, META, select=f"SELECT ticker, {r('prior_close')} AS prior_close, {r('mdv')} AS median_dollar_volume, security_type, is_etf, is_eligible, replace(why, ';', '|') AS reasons, why = '' AS eligible FROM elig"))
def _(spark, sf):
    """Reasons why a ticker does not trade."""
    return tidy(ss.eligibility(session_meta(settle(session_data(spark, sf)[3])), SPEC))


@query("baseline_a_signals", with_(GRIDDED, *BASELINE_A, select=f"SELECT ticker, {day('d')} AS session_date, 'baseline_a' AS strategy, si AS signal_idx, score, {r('stop')} AS stop_price FROM basig"))
def _(spark, sf):
    """The first bar of a session whose score reaches the minimum, band width ranked among the whole past."""
    return tidy(it.score_signals(settle(session_data(spark, sf)[3]), SPEC))


@query("session_trades", with_(*STUDY, select=f"SELECT ticker, {day('d')} AS session_date, strategy, scenario, si AS signal_idx, status, {r('eo')} AS entry_open, {r('stop')} AS stop_price, exit_type, {r('raw')} AS raw_exit_price, {r('net_r')} AS net_r, {r('hold')} AS holding_minutes FROM tr"))
def _(spark, sf):
    t = session_signals(spark, sf)[0].filter("status <> 'no_signal'")
    return tidy(t.select("ticker", "session_date", "strategy", "scenario", "signal_idx", "status", "entry_open", "stop_price", "exit_type", "raw_exit_price", "net_r", "holding_minutes"))


@query("session_signals", with_(*STUDY, select=f"SELECT ticker, {day('d')} AS session_date, strategy, scenario, is_etf, status, reason, drive AS opening_drive_qualified, score, {r('gap')} AS opening_gap, month FROM sg"))
def _(spark, sf):
    """Every session's outcome by strategy and scenario, with its reason."""
    return tidy(session_signals(spark, sf)[0].select("ticker", "session_date", "strategy", "scenario", "is_etf", "status", "reason", "opening_drive_qualified", "score", "opening_gap", "month"))


@query(
    "session_signal_counts",
    with_(*STUDY, METRICS, select=f"SELECT sc.* EXCLUDE (positive_trade_rate, average_holding_minutes), {r('positive_trade_rate')} AS positive_trade_rate, {r('average_holding_minutes')} AS average_holding_minutes FROM sc"),
)
def _(spark, sf):
    return tidy(ss.signal_counts(ss.grouped(session_signals(spark, sf)[0], "base"), ss.CELL))


@query("session_symbol_metrics", with_(*STUDY, METRICS, select=f"SELECT strategy, scenario, grouping, member, ticker, is_etf, n AS trade_count, {r('total')} AS total_return, {r('mean')} AS mean_expectancy, {r('gp')} AS gross_profit, {r('gl')} AS gross_loss, pc AS profit_factor_case, {r('pf')} AS profit_factor_value, {r('dd')} AS maximum_drawdown_pct, mean > 0 AS positive FROM sy"))
def _(spark, sf):
    return tidy(session_metrics(spark, sf)[1].drop("_executed", "profit_factor_order"))


WHOLE = ["total_signals", "executed_trades", "rejected_signals", "no_signal_count", *ss.REJECTIONS, *[f"exit_{t}" for t in ss.EXITS], "total_trades", "stock_stratum_trade_count", "etf_stratum_trade_count", "represented_symbols", "represented_stock_symbols", "represented_etf_symbols"]
PARTIAL = [
    "positive_trade_rate", "average_holding_minutes", "pooled_total_return", "pooled_expectancy", "overall_maximum_drawdown_pct", "stock_stratum_pooled_expectancy", "etf_stratum_pooled_expectancy", "median_per_symbol_expectancy", "equal_weighted_per_symbol_mean_expectancy",
    "positive_symbol_rate", "median_per_symbol_total_return", "median_per_symbol_maximum_drawdown_pct", "trade_count_concentration", "net_profit_concentration", "absolute_loss_concentration"]


@query(
    "session_study_metrics",
    with_(*STUDY, METRICS, select=f"""
SELECT strategy, scenario, grouping, member, {', '.join(WHOLE)}, {', '.join(f'{r(c)} AS {c}' for c in PARTIAL)}, CASE WHEN pfo >= 1e290 THEN 'unbounded' WHEN pfo IS NOT NULL THEN 'finite' ELSE 'none' END AS median_profit_factor, {r('CASE WHEN pfo < 1e290 THEN pfo END')} AS median_per_symbol_profit_factor_value FROM mt"""),
)
def _(spark, sf):
    """Metrics of each strategy: all trades, by month and by opening gap."""
    m = session_metrics(spark, sf)[0]
    order = F.col("median_per_symbol_profit_factor_order")
    shown = F.when(order == float("inf"), "unbounded").when(order.isNotNull(), "finite").otherwise("none")
    return tidy(m.withColumn("median_profit_factor", shown).drop("median_per_symbol_profit_factor_order"))


@query(
    "session_paired_outperformance",
    with_(*STUDY, METRICS, select=f"SELECT scenario, count(*) AS overlap, {r('avg((a.mean > b.mean)::INT)')} AS outperformance_rate FROM sy a JOIN sy b USING (scenario, grouping, ticker) WHERE a.strategy = 'candidate' AND b.strategy = 'baseline_b' AND grouping = 'all' GROUP BY 1"),
)
def _(spark, sf):
    return tidy(ss.paired_outperformance(session_metrics(spark, sf)[1].filter("grouping = 'all'"), "candidate", "baseline_b"))


SIDE = lambda s, c: f"any_value({c}) FILTER (strategy = '{s}')"


@query(
    "session_features",
    with_(*STUDY, select=f"""
SELECT ticker, {day('d')} AS session_date, {SIDE('candidate', 'status')} AS candidate_status, {SIDE('candidate', 'reason')} AS candidate_reason, {SIDE('candidate', 'drive')} AS candidate_opening_drive_qualified, {SIDE('baseline_a', 'status')} AS baseline_a_status,
  {SIDE('baseline_a', 'score')} AS baseline_a_score, {SIDE('baseline_b', 'status')} AS baseline_b_status FROM sg WHERE scenario = 'base' GROUP BY 1, d"""),
)
def _(spark, sf):
    """One row per ticker and session, the three strategies side by side."""
    return tidy(ss.session_features(session_signals(spark, sf)[0].filter("scenario = 'base'")))


@query(
    "session_ticker_comparison",
    with_(*STUDY, METRICS, select=f"""
SELECT c.ticker, c.is_etf, c.n AS candidate_trade_count, {r('c.total')} AS candidate_total_return, {r('c.mean')} AS candidate_mean_expectancy, {r('c.dd')} AS candidate_maximum_drawdown_pct, a.n AS baseline_a_trade_count, {r('a.mean')} AS baseline_a_mean_expectancy,
  b.n AS baseline_b_trade_count, {r('b.mean')} AS baseline_b_mean_expectancy, c.mean > a.mean AS candidate_beat_a, c.mean > b.mean AS candidate_beat_b
FROM sy c LEFT JOIN (SELECT * FROM sy WHERE strategy = 'baseline_a' AND scenario = 'base' AND grouping = 'all') a ON a.ticker = c.ticker LEFT JOIN (SELECT * FROM sy WHERE strategy = 'baseline_b' AND scenario = 'base' AND grouping = 'all') b ON b.ticker = c.ticker
WHERE c.strategy = 'candidate' AND c.scenario = 'base' AND c.grouping = 'all'"""),
)
def _(spark, sf):
    """The candidate's symbols next to both baselines."""
    return tidy(ss.ticker_comparison(session_metrics(spark, sf)[1].filter("grouping = 'all' AND scenario = 'base'")))


MINIMUMS = ss.SampleMinimums(trades=10, stock_symbols=1, etf_symbols=1, stock_trades=3, etf_trades=3, overlap=2, max_pct_of_trades=60.0, max_pct_of_profit=100.0)
ROW = lambda s, c, n: f"(SELECT x FROM mt x WHERE x.strategy = '{s}' AND x.scenario = '{c}' AND x.grouping = 'all') AS {n}"
FMT = lambda x: f"printf('%.4f', ({x})::DOUBLE)"
PFO = lambda x: f"(CASE WHEN {x}.pfo IS NULL THEN 'none' WHEN {x}.pfo >= 1e290 THEN 'inf' ELSE {FMT(f'{x}.pfo')} END)"
LIFT = lambda n, s, k: f"SELECT '{n}' AS gate, c.median_per_symbol_expectancy >= {s}.median_per_symbol_expectancy + {k} AS passed, CASE WHEN c.median_per_symbol_expectancy IS NULL OR {s}.median_per_symbol_expectancy IS NULL THEN 'median_per_symbol_expectancy_not_computable' ELSE 'candidate=' || {FMT('c.median_per_symbol_expectancy')} || '_baseline_{s}=' || {FMT(f'{s}.median_per_symbol_expectancy')} || '_lift_required={k}' END AS reason FROM g0"
GATES = f"""
qual AS (SELECT ticker, count(DISTINCT ld) FILTER (ld IN (SELECT d FROM sess)) AS ses, count(*) FILTER (NOT (slot BETWEEN 0 AND 5 AND ld IN (SELECT d FROM sess))) AS off, count(*) FILTER (slot BETWEEN 0 AND 5 AND ld IN (SELECT d FROM sess)) AS ok FROM bars GROUP BY 1),
short AS (SELECT 'missing_bar_rate_above_5%' AS x, count(*) AS n FROM qual WHERE (6 * ses - ok) / (6e0 * ses) > 0.05),
shorts AS (SELECT CASE WHEN n > 0 THEN [x || ' (' || n || ' symbol-month' || CASE WHEN n <> 1 THEN 's' ELSE '' END || ')'] ELSE [] END AS l FROM short),
g0 AS MATERIALIZED (SELECT {ROW('candidate', 'base', 'c')}, {ROW('baseline_a', 'base', 'a')}, {ROW('baseline_b', 'base', 'b')}, {ROW('candidate', 'stress', 'dr')},
  (SELECT count(*) FROM sy x JOIN sy y USING (scenario, grouping, ticker) WHERE x.strategy = 'candidate' AND y.strategy = 'baseline_a' AND grouping = 'all' AND scenario = 'base') AS ov,
  (SELECT coalesce(avg((x.mean > y.mean)::INT), 0) FROM sy x JOIN sy y USING (scenario, grouping, ticker) WHERE x.strategy = 'candidate' AND y.strategy = 'baseline_a' AND grouping = 'all' AND scenario = 'base') AS rt),
g1 AS MATERIALIZED (SELECT list_concat(list_filter([CASE WHEN c.total_trades < 10 THEN 'executed_candidate_trades_' || c.total_trades || '_below_10' END, CASE WHEN c.represented_stock_symbols < 1 THEN 'represented_stock_symbols_' || c.represented_stock_symbols || '_below_1' END,
    CASE WHEN c.represented_etf_symbols < 1 THEN 'represented_etfs_' || c.represented_etf_symbols || '_below_1' END, CASE WHEN c.stock_stratum_trade_count < 3 THEN 'stock_stratum_trades_' || c.stock_stratum_trade_count || '_below_3' END, CASE WHEN c.etf_stratum_trade_count < 3 THEN 'etf_stratum_trades_' || c.etf_stratum_trade_count || '_below_3' END,
    CASE WHEN c.trade_count_concentration * 100 > 60 THEN printf('trade_count_concentration_%.2f%%', c.trade_count_concentration * 100) || '_exceeds_60.0%' END, CASE WHEN c.net_profit_concentration * 100 > 100 THEN printf('net_profit_concentration_%.2f%%', c.net_profit_concentration * 100) || '_exceeds_100.0%' END,
    CASE WHEN c.absolute_loss_concentration * 100 > 100 THEN printf('absolute_loss_concentration_%.2f%%', c.absolute_loss_concentration * 100) || '_exceeds_100.0%' END], lambda x: x IS NOT NULL), CASE WHEN len(l) > 0 THEN list_concat(['data_sufficiency_failed'], l) ELSE [] END) AS rs FROM g0, shorts),
gt AS MATERIALIZED (
  SELECT '1_sample_and_data_sufficiency' AS gate, len(rs) = 0 AS passed, CASE WHEN len(rs) = 0 THEN 'ok' ELSE array_to_string(rs, '; ') END AS reason FROM g1
  UNION ALL SELECT '2_candidate_pooled_expectancy_positive_5bps', c.pooled_expectancy > 0, 'pooled_expectancy=' || {FMT('c.pooled_expectancy')} FROM g0
  UNION ALL {LIFT('3_candidate_median_expectancy_vs_baseline_a', 'a', 0.05)} UNION ALL {LIFT('4_candidate_median_expectancy_vs_baseline_b', 'b', 0.03)}
  UNION ALL SELECT '5_candidate_median_profit_factor_threshold', c.pfo >= 1.05, CASE WHEN c.pfo IS NULL THEN 'profit_factor_median_not_computable' ELSE 'median_pf_order=' || {PFO('c')} END FROM g0
  UNION ALL SELECT '6_candidate_median_profit_factor_not_below_baselines', least(c.pfo, 1e290) >= least(a.pfo, 1e290) AND least(c.pfo, 1e290) >= least(b.pfo, 1e290) AND (c.pfo + a.pfo + b.pfo) IS NOT NULL, CASE WHEN (c.pfo + a.pfo + b.pfo) IS NULL THEN 'profit_factor_median_not_comparable' ELSE 'candidate=' || {PFO('c')} || '_vs_a=' || {PFO('a')} || '_vs_b=' || {PFO('b')} END FROM g0
  UNION ALL SELECT '7_positive_symbol_rate', c.positive_symbol_rate >= 0.55, coalesce('positive_symbol_rate=' || {FMT('c.positive_symbol_rate')}, 'positive_symbol_rate_not_computable') FROM g0
  UNION ALL SELECT '8_paired_symbol_outperformance_vs_baseline_a', CASE WHEN ov >= 2 THEN rt >= 0.55 END, CASE WHEN ov < 2 THEN 'paired_overlap_' || ov || '_below_2' ELSE 'paired_overlap=' || ov || '_outperform_rate=' || {FMT('rt')} END FROM g0
  UNION ALL SELECT '9_median_drawdown_not_worse_than_baseline', c.median_per_symbol_maximum_drawdown_pct >= a.median_per_symbol_maximum_drawdown_pct - 2, coalesce('candidate_mdd=' || {FMT('c.median_per_symbol_maximum_drawdown_pct')} || '_baseline_mdd=' || {FMT('a.median_per_symbol_maximum_drawdown_pct')} || '_tolerance=2.0', 'median_mdd_not_computable') FROM g0
  UNION ALL SELECT '10_stock_and_etf_strata_nonneg_expectancy', c.stock_stratum_pooled_expectancy >= 0 AND c.etf_stratum_pooled_expectancy >= 0, 'stock=' || {FMT('c.stock_stratum_pooled_expectancy')} || '_etf=' || {FMT('c.etf_stratum_pooled_expectancy')} FROM g0
  UNION ALL SELECT '11_candidate_pooled_expectancy_nonneg_10bps', dr.pooled_expectancy >= 0, 'pooled_expectancy_10bps=' || {FMT('dr.pooled_expectancy')} FROM g0
  UNION ALL SELECT '12_concentration_limits', c.trade_count_concentration * 100 <= 60 AND coalesce(c.net_profit_concentration * 100 <= 100, true) AND coalesce(c.absolute_loss_concentration * 100 <= 100, true), 'concentration_within_limits' FROM g0)"""


def gates_of(spark, sf, lenient):
    metrics, symbols, (bars, sessions, grid, b) = session_metrics(spark, sf)
    every = metrics.filter("grouping = 'all'")
    paired = ss.paired_outperformance(symbols.filter("grouping = 'all'"), "candidate", "baseline_a")
    quality = settle(it.session_quality(bars, sessions, grid, b))
    contract = F.array().cast("array<string>") if lenient else it.contract_reasons()
    return ss.evaluate_gates(every, paired, ss.data_reasons(quality, contract, it.sufficiency_reasons()), "base", "stress", MINIMUMS)


@query(
    "session_gates",
    with_(*STUDY, METRICS, GATES, select="""
SELECT gate, passed, reason, CASE WHEN (SELECT len(rs) FROM g1) > 0 OR (SELECT count(*) FROM gt WHERE passed IS NULL) > 0 THEN 'inconclusive' WHEN (SELECT bool_and(passed) FROM gt) THEN 'supported' ELSE 'not_supported' END AS disposition,
  CASE WHEN (SELECT len(rs) FROM g1) > 0 THEN 'sample_or_data_sufficiency_minimums_not_met: ' || (SELECT array_to_string(rs, '; ') FROM g1) WHEN (SELECT count(*) FROM gt WHERE passed IS NULL) > 0 THEN 'required_gate_not_computable' WHEN (SELECT bool_and(passed) FROM gt) THEN 'all_gates_passed'
    ELSE 'gates_failed: ' || (SELECT string_agg(gate, ', ' ORDER BY split_part(gate, '_', 1)::INT) FROM gt WHERE NOT passed) END AS disposition_reason FROM gt"""),
)
def _(spark, sf):
    """The twelve gates of the study, bars outside the session's grid (premarket and after-hours prints) being allowed."""
    return gates_of(spark, sf, lenient=True)


@query(
    "session_gates_by_contract",
    with_(*STUDY, METRICS, GATES, select="""
SELECT gate, passed, reason, 'invalid' AS disposition, (SELECT string_agg(ticker || ':off_grid_bars=' || off, '; ' ORDER BY ticker || ':off_grid_bars=' || off) FROM qual WHERE off > 0) AS disposition_reason FROM gt WHERE gate LIKE '1!_%' ESCAPE '!'"""),
)
def _(spark, sf):
    """The same study under its data contract, which bars off the grid break: invalid, with the reasons."""
    return gates_of(spark, sf, lenient=False)


# ---- weekly study --------------------------------------------------------------------------------
W = wk.WeeklySpec()
WEEKLY_STUDY = f"""
{MARKET}, mkb AS (SELECT 'M' AS ticker, * FROM mk), {WEEKLY.replace('sess AS', 'msess AS').replace('JOIN sess s', 'JOIN msess s').replace('wk AS', 'mwk AS').replace('FROM bars b ASOF', 'FROM mkb b ASOF')},
ws AS MATERIALIZED (
  SELECT *, {LONG_SCORE} AS score, CASE WHEN pos >= 39 THEN avg(close) OVER (PARTITION BY ticker ORDER BY pos ROWS 39 PRECEDING) END AS sma, {split_sql('ts')} AS split FROM lr),
wf AS MATERIALIZED (SELECT *, coalesce(score >= 40, false) AS cand, coalesce(close > sma, false) AS base FROM ws WHERE pos >= 59 AND split IS NOT NULL),
we AS MATERIALIZED (
  SELECT f.ticker, f.pos, f.split, f.ts, rule, h AS horizon, CASE WHEN cand AND base THEN 'baseline_and_candidate' ELSE rule || '_only' END AS overlap_group, CASE WHEN rule = 'candidate' THEN f.score END AS score,
    e.open AS eo, x.close AS xc, CASE WHEN e.ts IS NULL THEN 'insufficient_future_bars' WHEN coalesce({split_sql('e.first_session')} <> f.split, true) THEN 'cross_split_excluded' WHEN x.ts IS NULL THEN 'insufficient_future_bars'
      WHEN coalesce({split_sql('x.ts')} <> f.split, true) THEN 'cross_split_excluded' ELSE 'complete' END AS status, mo.open AS mopen, mc.close AS mclose
  FROM wf f CROSS JOIN (SELECT unnest(['candidate', 'baseline']) AS rule) CROSS JOIN (SELECT unnest([13, 26]) AS h)
  LEFT JOIN ws e ON e.ticker = f.ticker AND e.pos = f.pos + 1 LEFT JOIN ws x ON x.ticker = f.ticker AND x.pos = f.pos + 1 + h
  LEFT JOIN mwk mo ON mo.ts = e.ts LEFT JOIN mwk mc ON mc.ts = x.ts WHERE (rule = 'candidate' AND cand) OR (rule = 'baseline' AND base)),
wev AS MATERIALIZED (SELECT *, CASE WHEN status = 'complete' THEN (xc / eo - 1) * 100 END AS gross, CASE WHEN status = 'complete' AND mopen > 0 THEN (mclose / mopen - 1) * 100 END AS mret FROM we),
ww AS (
  SELECT ticker, rule, 58::BIGINT AS pos, 0::BIGINT AS free, false AS taken FROM (SELECT DISTINCT ticker, rule FROM wev)
  UNION ALL
  SELECT w.ticker, w.rule, w.pos + 1, CASE WHEN c.pos >= w.free THEN c.pos + CASE WHEN c.status = 'cross_split_excluded' THEN 1 WHEN c.status = 'complete' THEN 15 ELSE 1000000 END ELSE w.free END, coalesce(c.pos >= w.free, false)
  FROM ww w JOIN ws s ON s.ticker = w.ticker AND s.pos = w.pos + 1 LEFT JOIN wev c ON c.ticker = w.ticker AND c.rule = w.rule AND c.pos = w.pos + 1 AND c.horizon = 13),
wt AS MATERIALIZED (SELECT v.* FROM wev v JOIN ww w ON w.ticker = v.ticker AND w.rule = v.rule AND w.pos = v.pos AND w.taken)"""
WPARTS = [DAILY, WEEKLY, numbered("wk"), indicators(), EXPANDING, WEEKLY_STUDY]


def weekly_rows(spark, sf, trades):
    signals = wk.weekly_signals(weekly(spark, sf), W, SPLITS)
    market = src.market_bars(spark, sf)
    market_weekly = cal.weekly_bars(market, cal.calendar_of(market))
    events = settle(wk.weekly_events(signals, market_weekly, W, SPLITS).drop("entry_at"))
    return settle(wk.weekly_trades(events, W)) if trades else events


@query("weekly_study_events", with_(*WPARTS, select=f"SELECT ticker, split, {day('ts')} AS signal_time, rule, overlap_group, horizon::BIGINT AS horizon, status AS outcome_status, {r('gross', 3)} AS gross_return_pct, {r('mret', 3)} AS market_return_pct FROM wev"))
def _(spark, sf):
    return tidy(weekly_rows(spark, sf, False).select("ticker", "split", "signal_time", "rule", "overlap_group", "horizon", "outcome_status", "gross_return_pct", "market_return_pct"), 3)


@query("weekly_study_trades", with_(*WPARTS, select=f"SELECT ticker, split, {day('ts')} AS signal_time, rule, horizon::BIGINT AS horizon, status AS outcome_status, {r('gross', 3)} AS gross_return_pct FROM wt"))
def _(spark, sf):
    return tidy(weekly_rows(spark, sf, True).select("ticker", "split", "signal_time", "rule", "horizon", "outcome_status", "gross_return_pct"), 3)


@query(
    "weekly_study_summary",
    with_(*WPARTS, select=f"""
SELECT rule, split, horizon::BIGINT AS horizon, CASE WHEN grouping(overlap_group) = 0 THEN 'overlap_group' WHEN grouping(bucket) = 0 THEN 'score_bucket' WHEN grouping(ticker) = 0 THEN 'ticker' ELSE 'total' END AS "table",
  coalesce(overlap_group, bucket, ticker) AS member, count(*) AS count, {r('avg(gross)', 3)} AS mean_return_pct, {r('stddev_pop(gross)', 3)} AS std_return_pct, {r('avg((gross > 0)::INT) * 100', 3)} AS win_rate_pct
FROM (SELECT *, CASE WHEN score < 25 THEN '0-24' WHEN score < 40 THEN '25-39' WHEN score < 60 THEN '40-59' WHEN score < 80 THEN '60-79' WHEN score IS NOT NULL THEN '80-100' END AS bucket FROM wev WHERE gross IS NOT NULL)
GROUP BY GROUPING SETS ((rule, split, horizon), (rule, split, horizon, overlap_group), (rule, split, horizon, bucket), (rule, split, horizon, ticker))"""),
)
def _(spark, sf):
    return tidy(wk.summary_tables(weekly_rows(spark, sf, False), "gross_return_pct", W), 3)


@query(
    "weekly_study_downside",
    with_(*WPARTS, """
cu AS (SELECT *, sum(gross) OVER (PARTITION BY rule, split, horizon ORDER BY ticker, ts) AS cum FROM wt WHERE gross IS NOT NULL),
dd AS (SELECT *, cum - max(cum) OVER (PARTITION BY rule, split, horizon ORDER BY ticker, ts) AS dr FROM cu)""",
        select=f"SELECT rule, split, horizon::BIGINT AS horizon, count(*) AS count, " + ", ".join(f"{r(f'quantile_cont(gross, {q})', 3)} AS {n}" for n, q in (("q10", 0.1), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q90", 0.9))) + f", {r('min(dr)', 3)} AS max_drawdown_pct FROM dd GROUP BY 1, 2, 3"),
)
def _(spark, sf):
    return tidy(wk.downside(weekly_rows(spark, sf, True), "gross_return_pct"), 3)


WNET = lambda s: f"((xc * (1 - {s}e-4)) / (eo * (1 + {s}e-4)) - 1) * 100"


@query(
    "weekly_study_costs",
    with_(*WPARTS, select="\nUNION ALL\n".join(
        f"SELECT rule, split, horizon::BIGINT AS horizon, {s}e0 AS slippage_bps, count(*) AS count, {r(f'avg({WNET(s)})', 3)} AS mean_net_return_pct, {r(f'avg((({WNET(s)}) > 0)::INT)', 3)} AS win_rate, {r(f'quantile_cont({WNET(s)}, 0.5)', 3)} AS median_net_return_pct FROM wt WHERE status = 'complete' GROUP BY 1, 2, 3"
        for s in (0, 10, 25))),
)
def _(spark, sf):
    return tidy(wk.cost_sensitivity(weekly_rows(spark, sf, True), W), 3)


@query("weekly_study_exposure", with_(*WPARTS, select="SELECT ticker, rule, split, count(*) AS trade_count, count(*) FILTER (status = 'complete') AS complete_count, 13 * count(*) FILTER (status = 'complete') AS weeks_in_market FROM wt WHERE horizon = 13 GROUP BY 1, 2, 3"))
def _(spark, sf):
    return tidy(wk.exposure(weekly_rows(spark, sf, True), W))


@query(
    "weekly_paired_clusters",
    with_(*WPARTS, select=f"""
SELECT split, horizon::BIGINT AS horizon, ticker, year(ts) AS year, {r("avg(gross) FILTER (rule = 'candidate')", 3)} AS candidate, {r("avg(gross) FILTER (rule = 'baseline')", 3)} AS baseline
FROM wev WHERE gross IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (rule = 'candidate') > 0 AND count(*) FILTER (rule = 'baseline') > 0"""),
)
def _(spark, sf):
    return tidy(wk.paired_clusters(weekly_rows(spark, sf, False), "gross_return_pct").drop("difference"), 3)


SHARE = lambda c: f"avg((cm > bm)::INT) FILTER (cn >= 5 AND bn >= 5 AND cohort = '{c}')"
EVIDENCE = f"""
tn AS MATERIALIZED (SELECT split, ticker, CASE WHEN ticker LIKE '%5' THEN 'etf' ELSE 'stock' END AS cohort, rule, {WNET(10)} AS net, {WNET(25)} AS dear FROM wt WHERE status = 'complete' AND horizon = 13),
ev AS (SELECT split, ticker, cohort, count(*) FILTER (rule = 'candidate') AS cn, avg(net) FILTER (rule = 'candidate') AS cm, count(*) FILTER (rule = 'baseline') AS bn, avg(net) FILTER (rule = 'baseline') AS bm FROM tn GROUP BY ALL),
eg AS (SELECT split, avg(net) FILTER (rule = 'candidate') - avg(net) FILTER (rule = 'baseline') AS lift, avg(dear) FILTER (rule = 'candidate') - avg(dear) FILTER (rule = 'baseline') AS dl, quantile_cont(net, 0.1) FILTER (rule = 'candidate') - quantile_cont(net, 0.1) FILTER (rule = 'baseline') AS ql FROM tn GROUP BY 1)"""
EVIDENCED = wk.WeeklySpec(decision_bps=10.0, minimum_signals=20, minimum_stock_tickers=5, minimum_etf_tickers=2)


def weekly_evidence(spark, sf):
    cohort = F.when(F.col("ticker").like("%5"), "etf").otherwise("stock")
    return wk.split_evidence(weekly_rows(spark, sf, True).withColumn("cohort", cohort), EVIDENCED)


@query(
    "weekly_evidence",
    with_(*WPARTS, EVIDENCE, select=f"""
SELECT split, sum(cn)::BIGINT AS candidate_count, sum(bn)::BIGINT AS baseline_count, {r('any_value(lift)', 3)} AS lift_pct, {r('any_value(dl)', 3)} AS sensitivity_lift_pct, {r('any_value(ql)', 3)} AS q10_lift_pct,
  count(*) FILTER (cn > 0 AND cohort = 'stock') AS candidate_stock_tickers, count(*) FILTER (cn > 0 AND cohort = 'etf') AS candidate_etf_tickers, count(*) FILTER (bn > 0 AND cohort = 'stock') AS baseline_stock_tickers, count(*) FILTER (bn > 0 AND cohort = 'etf') AS baseline_etf_tickers,
  {r(SHARE('stock'), 3)} AS leading_stock_share, {r(SHARE('etf'), 3)} AS leading_etf_share FROM ev JOIN eg USING (split) GROUP BY 1"""),
)
def _(spark, sf):
    return tidy(weekly_evidence(spark, sf), 3)


PAIRS = f"""
pc AS MATERIALIZED (
  SELECT split, horizon, ticker || ':' || year(ts) AS cluster, avg({WNET(10)}) FILTER (rule = 'candidate') - avg({WNET(10)}) FILTER (rule = 'baseline') AS s, 1 AS n
  FROM wt WHERE status = 'complete' GROUP BY split, horizon, ticker, year(ts) HAVING count(*) FILTER (rule = 'candidate') > 0 AND count(*) FILTER (rule = 'baseline') > 0)"""
VERDICT = f"""
ci AS (SELECT split, horizon, quantile_cont(s / n, 0.025) AS lo, quantile_cont(s / n, 0.975) AS hi FROM pb GROUP BY 1, 2),
es AS (SELECT split, sum(cn)::BIGINT AS cc, sum(bn)::BIGINT AS bc, any_value(lift) AS lift, any_value(dl) AS dl, any_value(ql) AS ql, count(*) FILTER (cn > 0 AND cohort = 'stock') AS cs, count(*) FILTER (cn > 0 AND cohort = 'etf') AS ce,
  count(*) FILTER (bn > 0 AND cohort = 'stock') AS bs, count(*) FILTER (bn > 0 AND cohort = 'etf') AS be, {SHARE('stock')} AS ls, {SHARE('etf')} AS le FROM ev JOIN eg USING (split) GROUP BY 1),
one AS (SELECT h.*, lo, hi, (SELECT lift FROM es WHERE split = 'validation') AS vl FROM (SELECT 1) LEFT JOIN (SELECT * FROM es WHERE split = 'holdout') h ON true LEFT JOIN (SELECT * FROM ci WHERE split = 'holdout' AND horizon = 13) ON true)"""


@query(
    "weekly_conclusion",
    with_(*WPARTS, EVIDENCE, PAIRS, bootstrap("pc", "split, horizon", ["s", "n"], EVIDENCED.bootstrap_resamples, EVIDENCED.bootstrap_seed, "pb"), VERDICT, select=f"""
SELECT cc AS candidate_count, bc AS baseline_count, {r('lift', 3)} AS lift_pct, {r('dl', 3)} AS sensitivity_lift_pct, cs AS candidate_stock_tickers, ce AS candidate_etf_tickers, bs AS baseline_stock_tickers, be AS baseline_etf_tickers, {r('ls', 3)} AS leading_stock_share, {r('le', 3)} AS leading_etf_share,
  {r('ql', 3)} AS q10_lift_pct, {r('lo', 3)} AS ci_low, {r('hi', 3)} AS ci_high, {r('vl', 3)} AS validation_lift_pct,
  CASE WHEN coalesce(hi <= 0, false) OR coalesce(lift <= -0.5, false) OR (coalesce(ql < -2, false) AND coalesce(lift <= 0, true)) THEN 'reject_or_deprioritize'
    WHEN coalesce(cc >= 20 AND bc >= 20 AND cs >= 5 AND ce >= 2 AND bs >= 5 AND be >= 2 AND lift >= 0.5 AND lo > 0 AND ql >= -1 AND dl > 0 AND ls >= 0.6 AND le >= 0.6 AND vl > 0, false) THEN 'supports_further_research' ELSE 'inconclusive' END AS conclusion FROM one"""),
)
def _(spark, sf):
    """The study's verdict from the holdout's evidence and the interval of paired clusters."""
    boot = wk.paired_bootstrap(weekly_rows(spark, sf, True).filter("outcome_status = 'complete'"), "net_return_pct_10bps", EVIDENCED)
    return tidy(wk.conclusion(weekly_evidence(spark, sf), boot, EVIDENCED), 3)


@query(
    "weekly_rule_lift",
    with_(*WPARTS, """
pt AS (SELECT split, horizon, ticker, count(*) FILTER (rule = 'candidate') AS cn, avg(gross) FILTER (rule = 'candidate') AS cm, coalesce(sum(gross) FILTER (rule = 'candidate'), 0) AS cs,
  count(*) FILTER (rule = 'baseline') AS bn, avg(gross) FILTER (rule = 'baseline') AS bm, coalesce(sum(gross) FILTER (rule = 'baseline'), 0) AS bs FROM wev WHERE gross IS NOT NULL GROUP BY ALL)""",
        select=f"SELECT split, horizon::BIGINT AS horizon, {r('sum(cs) / sum(cn) - sum(bs) / sum(bn)', 3)} AS pooled_lift_pct, count(*) FILTER (cn >= 5 AND bn >= 5) AS compared_tickers, {r('avg((cm > bm)::INT) FILTER (cn >= 5 AND bn >= 5)', 3)} AS positive_fraction FROM pt GROUP BY 1, 2"),
)
def _(spark, sf):
    return tidy(wk.rule_lift(weekly_rows(spark, sf, False), "gross_return_pct"), 3)
