"""Event study and backtest."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.config import BacktestConfig, EventStudyConfig, Split
from barloom.operators.stats import METRICS
from barloom.plans import backtest as bt
from barloom.plans import event_study as es
from barloom.session import settle
from barloom.sources import bars as src
from oracle.sql import DAILY, day, indicators, numbered, r, short_scores, with_

from .base import query, tidy

SPLITS = [Split("development", "1995-01-01", "1997-12-31"), Split("validation", "1998-01-01", "1999-06-30"), Split("holdout", "1999-07-01", "2002-12-31")]
STUDY = EventStudyConfig(commission_bps=1.0)
SCORED = [DAILY, numbered(), indicators(), short_scores()]


def split_sql(x):
    return "CASE " + " ".join(f"WHEN {x} >= DATE '{s.start}' AND {x} < DATE '{s.end}' + INTERVAL 1 DAY THEN '{s.name}'" for s in SPLITS) + " END"


EVENTS = f"""
ev AS MATERIALIZED (
  SELECT s.*, {split_sql('s.ts')} AS split, {split_sql('e.ts')} AS esplit, e.open AS entry, e.ts AS entry_time
  FROM sc s LEFT JOIN b e ON e.ticker = s.ticker AND e.pos = s.pos + 1 WHERE s.pos >= 60),
oc AS MATERIALIZED (
  SELECT ev.*, h AS horizon_bars, slip AS slippage_bps, x.close AS xclose, x.ts AS xts,
    coalesce(esplit = split AND {split_sql('x.ts')} = split, false) AS complete,
    ((x.close * (1 - slip / 1e4)) * (1 - 1e-4) / ((entry * (1 + slip / 1e4)) * (1 + 1e-4)) - 1) * 100 AS net
  FROM ev CROSS JOIN (SELECT unnest([1, 3, 5]) AS h) CROSS JOIN (SELECT unnest([0e0, 5e0, 10e0]) AS slip)
  LEFT JOIN b x ON x.ticker = ev.ticker AND x.pos = ev.pos + h
  WHERE split IS NOT NULL),
ok AS (SELECT * FROM oc WHERE complete)"""


def metric_sql(src, groups):
    return f"""
  SELECT {groups}, count(*) AS event_count, count(DISTINCT ticker) AS unique_tickers, avg(net) AS mean_net, quantile_cont(net, 0.5) AS med_net,
    avg((net > 0)::INT) * 100 AS pos_rate, stddev_pop(net) AS sd, quantile_cont(net, 0.25) AS p25, quantile_cont(net, 0.75) AS p75,
    min(net) AS mn, max(net) AS mx FROM {src} GROUP BY {groups}"""


def ticker_sql(src, groups):
    return f"SELECT {groups}, avg(m) AS mtm, median(m) AS mdm FROM (SELECT {groups}, ticker, avg(net) AS m FROM {src} GROUP BY {groups}, ticker) GROUP BY {groups}"


METRIC_OUT = ", ".join(
    ["coalesce(event_count, 0) AS event_count", "coalesce(unique_tickers, 0) AS unique_tickers"]
    + [f"{r(c)} AS {n}" for c, n in [
        ("mean_net", "mean_net_return_pct"), ("med_net", "median_net_return_pct"), ("pos_rate", "positive_return_rate_pct"),
        ("sd", "standard_deviation_pct"), ("p25", "p25_net_return_pct"), ("p75", "p75_net_return_pct"),
        ("mn", "minimum_net_return_pct"), ("mx", "maximum_net_return_pct"), ("mtm", "mean_ticker_event_return_pct"), ("mdm", "median_ticker_event_return_pct")]]
    + ["CASE WHEN coalesce(event_count, 0) >= 20 THEN 'sufficient_sample' ELSE 'insufficient_sample' END AS sample_status"]
)
CELLS = "(SELECT DISTINCT split FROM oc) CROSS JOIN (SELECT unnest([1, 3, 5]) AS horizon_bars) CROSS JOIN (SELECT unnest([0e0, 5e0, 10e0]) AS slippage_bps)"


def events_and_outcomes(spark, sf):
    events = es.score_events(src.daily_bars(spark, sf), STUDY, SPLITS)
    return events, es.event_outcomes(events, STUDY)


@query(
    "study_events",
    with_(*SCORED, EVENTS, select=f"""
SELECT ticker, split, {day('ts')} AS signal_time, score::BIGINT AS score, {r('close', 3)} AS signal_close,
  CASE WHEN esplit = split THEN {day('entry_time')} END AS entry_time, CASE WHEN esplit = split THEN {r('entry', 3)} END AS raw_entry_price
FROM ev WHERE split IS NOT NULL"""),
)
def _(spark, sf):
    events, _ = events_and_outcomes(spark, sf)
    return tidy(events.select("ticker", "split", "signal_time", "score", "signal_close", "entry_time", "raw_entry_price"), 3)


@query(
    "study_outcomes",
    with_(*SCORED, EVENTS, select=f"""
SELECT ticker, split, {day('ts')} AS signal_time, horizon_bars::BIGINT AS horizon_bars, slippage_bps, CASE WHEN complete THEN 'complete' ELSE 'insufficient_future_bars' END AS outcome_status,
  CASE WHEN complete THEN {day('xts')} END AS exit_time, CASE WHEN complete THEN {r('(xclose / entry - 1) * 100')} END AS gross_return_pct,
  CASE WHEN complete THEN {r('net')} END AS net_return_pct FROM oc"""),
)
def _(spark, sf):
    _, o = events_and_outcomes(spark, sf)
    return tidy(o.select("ticker", "split", "signal_time", "horizon_bars", "slippage_bps", "outcome_status", "exit_time", "gross_return_pct", "net_return_pct"))


@query(
    "study_score_buckets",
    with_(*SCORED, EVENTS, f"""
bk AS (SELECT *, CASE WHEN score < 20 THEN '0-19' WHEN score < 40 THEN '20-39' WHEN score < 60 THEN '40-59' WHEN score < 80 THEN '60-79' ELSE '80-100' END AS score_bucket FROM ok),
m AS ({metric_sql('bk', 'split, horizon_bars, slippage_bps, score_bucket')}), t AS ({ticker_sql('bk', 'split, horizon_bars, slippage_bps, score_bucket')})""",
        select=f"""
SELECT split, horizon_bars::BIGINT AS horizon_bars, slippage_bps, score_bucket, {METRIC_OUT}
FROM {CELLS} CROSS JOIN (SELECT unnest(['0-19', '20-39', '40-59', '60-79', '80-100']) AS score_bucket)
LEFT JOIN m USING (split, horizon_bars, slippage_bps, score_bucket) LEFT JOIN t USING (split, horizon_bars, slippage_bps, score_bucket)"""),
)
def _(spark, sf):
    _, o = events_and_outcomes(spark, sf)
    return tidy(es.score_buckets(settle(o.drop("reasons")), STUDY).select(*es.CELL, "score_bucket", *METRICS))


@query(
    "study_thresholds",
    with_(*SCORED, EVENTS, f"""
th AS (SELECT ok.*, threshold FROM ok JOIN (SELECT unnest([20, 30, 40, 50, 60, 70, 80]) AS threshold) ON score >= threshold),
m AS ({metric_sql('th', 'split, horizon_bars, slippage_bps, threshold')}), t AS ({ticker_sql('th', 'split, horizon_bars, slippage_bps, threshold')}),
tot AS (SELECT split, horizon_bars, slippage_bps, count(*) AS n, count(DISTINCT ticker) AS nt FROM ok GROUP BY ALL)""",
        select=f"""
SELECT split, horizon_bars::BIGINT AS horizon_bars, slippage_bps, threshold::BIGINT AS threshold, CASE WHEN threshold = 40 THEN 'current_default' ELSE 'threshold_' || threshold END AS threshold_label,
  {METRIC_OUT}, {r('coalesce(event_count / n * 100e0, 0)')} AS event_retention_pct, {r('coalesce(unique_tickers / nt * 100e0, 0)')} AS ticker_coverage_pct
FROM {CELLS} CROSS JOIN (SELECT unnest([20, 30, 40, 50, 60, 70, 80]) AS threshold)
LEFT JOIN m USING (split, horizon_bars, slippage_bps, threshold) LEFT JOIN t USING (split, horizon_bars, slippage_bps, threshold) LEFT JOIN tot USING (split, horizon_bars, slippage_bps)"""),
)
def _(spark, sf):
    _, o = events_and_outcomes(spark, sf)
    t = es.thresholds(settle(o.drop("reasons")), STUDY)
    return tidy(t.select(*es.CELL, "threshold", "threshold_label", *METRICS, "event_retention_pct", "ticker_coverage_pct"))


COMPONENT_ROWS = "\nUNION ALL\n".join(
    f"SELECT split, horizon_bars, slippage_bps, ticker, net, '{c}' AS component, CASE WHEN {c} THEN 'present' ELSE 'absent' END AS component_state FROM ok"
    for c in es.SHORT_COMPONENTS
)


@query(
    "study_components",
    with_(*SCORED, EVENTS, f"""
cr AS ({COMPONENT_ROWS}), m AS ({metric_sql('cr', 'split, horizon_bars, slippage_bps, component, component_state')}),
t AS ({ticker_sql('cr', 'split, horizon_bars, slippage_bps, component, component_state')}),
d AS (SELECT split, horizon_bars, slippage_bps, component,
  max(mean_net) FILTER (component_state = 'present') - max(mean_net) FILTER (component_state = 'absent') AS dm,
  max(med_net) FILTER (component_state = 'present') - max(med_net) FILTER (component_state = 'absent') AS dd,
  max(pos_rate) FILTER (component_state = 'present') - max(pos_rate) FILTER (component_state = 'absent') AS dp FROM m GROUP BY ALL)""",
        select=f"""
SELECT split, horizon_bars::BIGINT AS horizon_bars, slippage_bps, component, component_state, {METRIC_OUT},
  {r('dm')} AS mean_return_present_minus_absent, {r('dd')} AS median_return_present_minus_absent, {r('dp')} AS positive_rate_present_minus_absent
FROM {CELLS} CROSS JOIN (SELECT unnest({es.SHORT_COMPONENTS}) AS component) CROSS JOIN (SELECT unnest(['present', 'absent']) AS component_state)
LEFT JOIN m USING (split, horizon_bars, slippage_bps, component, component_state) LEFT JOIN t USING (split, horizon_bars, slippage_bps, component, component_state)
LEFT JOIN d USING (split, horizon_bars, slippage_bps, component)"""),
)
def _(spark, sf):
    _, o = events_and_outcomes(spark, sf)
    c = es.components(settle(o.drop("reasons")), STUDY)
    return tidy(c.select(*es.CELL, "component", "component_state", *METRICS, "mean_return_present_minus_absent", "median_return_present_minus_absent", "positive_rate_present_minus_absent"))


@query(
    "study_score_distribution",
    with_(*SCORED, EVENTS, select=f"""
SELECT split, score::BIGINT AS exact_score, count(*) AS event_count, count(DISTINCT ticker) AS unique_tickers,
  {r('count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY split)')} AS percentage_of_split_events FROM ev WHERE split IS NOT NULL GROUP BY split, score"""),
)
def _(spark, sf):
    events, _ = events_and_outcomes(spark, sf)
    return tidy(es.score_distribution(events))


@query(
    "study_component_frequency",
    with_(*SCORED, EVENTS, select="\nUNION ALL\n".join(
        f"SELECT split, '{c}' AS component, count(*) FILTER ({c}) AS present_count, {r(f'avg({c}::INT) * 100')} AS present_pct FROM ev WHERE split IS NOT NULL GROUP BY split"
        for c in es.SHORT_COMPONENTS)),
)
def _(spark, sf):
    events, _ = events_and_outcomes(spark, sf)
    return tidy(es.component_frequency(events))


@query(
    "study_ticker_summary",
    with_(*SCORED, EVENTS, select=f"""
SELECT split, ticker, horizon_bars::BIGINT AS horizon_bars, slippage_bps, count(*) AS event_count, {r('avg(net)')} AS mean_net_return_pct,
  {r('quantile_cont(net, 0.5)')} AS median_net_return_pct, {r('avg((net > 0)::INT) * 100')} AS positive_return_rate_pct FROM ok GROUP BY ALL"""),
)
def _(spark, sf):
    _, o = events_and_outcomes(spark, sf)
    return tidy(es.ticker_summary(settle(o.drop("reasons"))))


@query(
    "study_data_quality",
    with_(*SCORED, EVENTS, select="""
SELECT ticker, count(*) FILTER (split = 'development') AS development_events, count(*) FILTER (split = 'validation') AS validation_events,
  count(*) FILTER (split = 'holdout') AS holdout_events, (SELECT count(*) FROM ok o WHERE o.ticker = ev.ticker AND horizon_bars = 1 AND slippage_bps = 0) AS complete_1_bar_outcomes,
  (SELECT count(*) FROM ok o WHERE o.ticker = ev.ticker AND horizon_bars = 3 AND slippage_bps = 0) AS complete_3_bar_outcomes,
  (SELECT count(*) FROM ok o WHERE o.ticker = ev.ticker AND horizon_bars = 5 AND slippage_bps = 0) AS complete_5_bar_outcomes
FROM ev WHERE split IS NOT NULL GROUP BY ticker"""),
)
def _(spark, sf):
    events, _ = events_and_outcomes(spark, sf)
    return es.study_quality(events, STUDY, SPLITS)


BT = BacktestConfig(min_score=40, max_holding_bars=3, stop_loss_pct=0.30, take_profit_pct=0.40, slippage_bps=5.0, commission_bps=1.0)
BACKTEST = f"""
cand AS MATERIALIZED (
  SELECT s.ticker, s.pos, s.ts, s.score, e.open AS entry, e.open * 1.0005e0 AS fill, e.ts AS entry_time
  FROM sc s JOIN b e ON e.ticker = s.ticker AND e.pos = s.pos + 1 WHERE s.pos >= 59 AND s.score >= 40),
ex AS MATERIALIZED (
  SELECT c.*, j.pos AS xpos, j.ts AS xts,
    CASE WHEN j.open <= fill * (1 - 0.30e0) THEN 'gap_stop' WHEN j.open >= fill * (1 + 0.40e0) THEN 'gap_target' WHEN j.low <= fill * (1 - 0.30e0) THEN 'stop'
         WHEN j.high >= fill * (1 + 0.40e0) THEN 'target' WHEN j.pos = least(c.pos + 3, lastpos) THEN 'time_exit' END AS reason,
    CASE WHEN j.open <= fill * (1 - 0.30e0) OR j.open >= fill * (1 + 0.40e0) THEN j.open WHEN j.low <= fill * (1 - 0.30e0) THEN fill * (1 - 0.30e0)
         WHEN j.high >= fill * (1 + 0.40e0) THEN fill * (1 + 0.40e0) ELSE j.close END AS xprice
  FROM cand c JOIN (SELECT ticker, max(pos) AS lastpos FROM b GROUP BY 1) l ON l.ticker = c.ticker
  JOIN b j ON j.ticker = c.ticker AND j.pos BETWEEN c.pos + 1 AND c.pos + 3),
pt AS MATERIALIZED (
  SELECT *, (xprice * (1 - 5e-4)) * (1 - 1e-4) / (fill * (1 + 1e-4)) AS factor
  FROM ex WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, pos ORDER BY xpos) = 1),
walk AS (
  SELECT b.ticker, b.pos, -1::BIGINT AS held, false AS taken FROM b WHERE pos = 0
  UNION ALL
  SELECT w.ticker, w.pos + 1, CASE WHEN p.pos IS NOT NULL AND p.pos >= w.held THEN p.xpos ELSE w.held END, p.pos IS NOT NULL AND p.pos >= w.held
  FROM walk w JOIN b ON b.ticker = w.ticker AND b.pos = w.pos + 1 LEFT JOIN pt p ON p.ticker = w.ticker AND p.pos = w.pos + 1),
tr AS MATERIALIZED (
  SELECT p.*, 1e5 * product(factor) OVER (PARTITION BY p.ticker ORDER BY p.pos) AS ending_cash FROM pt p JOIN walk w ON w.ticker = p.ticker AND w.pos = p.pos AND w.taken),
led AS MATERIALIZED (
  SELECT s.ticker, s.ts, s.pos, s.score, s.close, CASE WHEN s.score < 40 THEN 'below_threshold'
    WHEN EXISTS (SELECT 1 FROM tr t WHERE t.ticker = s.ticker AND t.pos < s.pos AND t.xpos > s.pos) THEN 'overlap'
    WHEN NOT EXISTS (SELECT 1 FROM tr t WHERE t.ticker = s.ticker AND t.pos = s.pos) THEN 'no_next_bar' END AS skip_reason
  FROM sc s WHERE s.pos >= 59),
eq AS MATERIALIZED (
  SELECT l.ticker, l.ts, l.pos, l.close, t.pos IS NOT NULL AS position_open, CASE WHEN t.xpos > l.pos THEN t.start / (t.fill * (1 + 1e-4)) * l.close
    ELSE coalesce((SELECT ending_cash FROM tr d WHERE d.ticker = l.ticker AND d.xpos <= l.pos ORDER BY d.xpos DESC LIMIT 1), 1e5) END AS equity
  FROM led l LEFT JOIN (SELECT *, ending_cash / factor AS start FROM tr) t ON t.ticker = l.ticker AND l.pos > t.pos AND l.pos <= t.xpos),
curve AS MATERIALIZED (
  SELECT *, equity / lag(equity) OVER (PARTITION BY ticker ORDER BY pos) - 1 AS ret, (equity / max(equity) OVER (PARTITION BY ticker ORDER BY pos) - 1) * 100 AS dd FROM eq)"""


def backtest(spark, sf):
    return bt.run_backtest(src.daily_bars(spark, sf), BT)


@query(
    "backtest_trades",
    with_(*SCORED, BACKTEST, select=f"""
SELECT ticker, {day('ts')} AS signal_time, {day('entry_time')} AS entry_time, {day('xts')} AS exit_time, score::BIGINT AS score, reason AS exit_reason,
  xpos - pos AS bars_held, {r('entry', 3)} AS raw_entry_price, {r('xprice', 3)} AS raw_exit_price, {r('(xprice / entry - 1) * 100', 3)} AS gross_return_pct,
  {r('(factor - 1) * 100', 3)} AS net_return_pct, {r('ln(ending_cash)')} AS log_ending_cash FROM tr"""),
)
def _(spark, sf):
    t = backtest(spark, sf)["trades"]
    return tidy(t.select("ticker", "signal_time", "entry_time", "exit_time", "score", "exit_reason", "bars_held", "raw_entry_price", "raw_exit_price", "gross_return_pct", "net_return_pct"), 3).join(
        tidy(t.select("ticker", "signal_time", F.log("ending_cash").alias("log_ending_cash"))), ["ticker", "signal_time"])


@query(
    "backtest_signals",
    with_(*SCORED, BACKTEST, select=f"SELECT ticker, {day('ts')} AS signal_time, pos, score::BIGINT AS score, CASE WHEN skip_reason IS NULL THEN 'executed' ELSE 'skipped' END AS execution_status, skip_reason FROM led"),
)
def _(spark, sf):
    return tidy(backtest(spark, sf)["signals"].drop("signal_close"))


@query(
    "backtest_equity",
    with_(*SCORED, BACKTEST, select=f"SELECT ticker, {day('ts')} AS ts, position_open, {r('ln(equity)')} AS log_equity, {r('ret')} AS daily_return, {r('dd', 3)} AS drawdown_pct FROM curve"),
)
def _(spark, sf):
    c = backtest(spark, sf)["equity"].withColumn("log_equity", F.log("equity"))
    return tidy(c.select("ticker", "ts", "position_open", "log_equity", "daily_return")).join(
        tidy(c.select("ticker", "ts", "drawdown_pct"), 3), ["ticker", "ts"])


@query(
    "backtest_metrics",
    with_(*SCORED, BACKTEST, select=f"""
SELECT e.ticker, {r('ln(ending)')} AS log_ending_capital, {r('ln((bh + 100) / 100)')} AS log_buy_and_hold, total_signals, qualifying_signals, skipped_overlap, skipped_no_next,
  coalesce(n, 0) AS total_trades, coalesce(wins, 0) AS winning_trades, coalesce(losses, 0) AS losing_trades, coalesce(n - wins - losses, 0) AS breakeven_trades, {r('wins * 100e0 / n', 3)} AS win_rate_pct, {r('mean', 3)} AS average_trade_return_pct,
  {r('med', 3)} AS median_trade_return_pct, {r('aw', 3)} AS average_win_pct, {r('al', 3)} AS average_loss_pct, {r('pf', 3)} AS profit_factor, {r('sharpe', 3)} AS sharpe_ratio,
  {r('mdd', 3)} AS max_drawdown_pct, {r('expo', 3)} AS exposure_pct
FROM (SELECT ticker, last(equity ORDER BY pos) AS ending, min(dd) AS mdd, avg(position_open::INT) * 100 AS expo, sqrt(252) * avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe FROM curve GROUP BY 1) e
JOIN (SELECT ticker, (last(close ORDER BY pos) * (1 - 5e-4) * (1 - 1e-4) / (first(open ORDER BY pos) * (1 + 5e-4) * (1 + 1e-4)) - 1) * 100 AS bh FROM b WHERE pos >= 59 GROUP BY 1) h ON h.ticker = e.ticker
JOIN (SELECT ticker, count(*) AS total_signals, count(*) FILTER (score >= 40) AS qualifying_signals, count(*) FILTER (skip_reason = 'overlap') AS skipped_overlap,
        count(*) FILTER (skip_reason = 'no_next_bar') AS skipped_no_next FROM led GROUP BY 1) s ON s.ticker = e.ticker
LEFT JOIN (SELECT ticker, count(*) AS n, count(*) FILTER (nr > 1e-9) AS wins, count(*) FILTER (nr < -1e-9) AS losses, avg(nr) AS mean, quantile_cont(nr, 0.5) AS med,
        avg(nr) FILTER (nr > 1e-9) AS aw, avg(nr) FILTER (nr < -1e-9) AS al,
        CASE WHEN count(*) FILTER (pnl < 0) > 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl < 0) END AS pf
      FROM (SELECT *, (factor - 1) * 100 AS nr, ending_cash - ending_cash / factor AS pnl FROM tr) GROUP BY 1) t ON t.ticker = e.ticker"""),
)
def _(spark, sf):
    m = backtest(spark, sf)["metrics"]
    logs = tidy(m.select("ticker", F.log("ending_capital").alias("log_ending_capital"), F.log((F.col("buy_and_hold_return_pct") + 100) / 100).alias("log_buy_and_hold")))
    rest = tidy(m.select(
        "ticker", "total_signals", "qualifying_signals", F.col("signals_skipped_overlap").alias("skipped_overlap"), F.col("signals_skipped_no_next_bar").alias("skipped_no_next"),
        "total_trades", "winning_trades", "losing_trades", "breakeven_trades", "win_rate_pct", "average_trade_return_pct", "median_trade_return_pct", "average_win_pct", "average_loss_pct",
        "profit_factor", "sharpe_ratio", "max_drawdown_pct", "exposure_pct"), 3)
    return rest.join(logs, "ticker")
