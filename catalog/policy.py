"""Context event study, gated backtest and policy selection."""
from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from barloom.operators.blocks import owned
from barloom.plans import backtest as bt
from barloom.plans import context as cx
from barloom.plans import context_study as cs
from barloom.plans import event_study as es
from barloom.session import settle
from barloom.sources import bars as src
from oracle.sql import DAILY, day, indicators, numbered, r, short_scores, with_

from .base import query, tidy
from .studies import BACKTEST, BT, EVENTS, SCORED, SPLITS, STUDY
from .tracking import REGIME, market_parts

CONTEXT_EVENTS = """
ce AS MATERIALIZED (
  SELECT o.*, g.bullish, s.pos_rs FROM oc o LEFT JOIN regime g ON g.ts = o.ts LEFT JOIN rs s ON s.ticker = o.ticker AND s.ts = o.ts WHERE horizon_bars = 3 AND slippage_bps = 5)"""


def context_events(spark, sf):
    bars, proxies, mapping = market_parts(spark, sf)
    events = es.score_events(bars, STUDY, SPLITS)
    outcomes = es.event_outcomes(events, STUDY).filter("horizon_bars = 3 AND slippage_bps = 5")
    signals = outcomes.select("ticker", F.col("signal_time").alias("ts"), "split", "score", "outcome_status", "net_return_pct")
    return cs.with_market_context(settle(signals), settle(cx.regimes(proxies)), settle(cx.relative_strength(bars, proxies, mapping)))


@query(
    "context_events",
    with_(*SCORED, EVENTS, REGIME, CONTEXT_EVENTS, select=f"""
SELECT ticker, split, {day('ts')} AS ts, score::BIGINT AS score, bullish AS market_regime_bullish, pos_rs AS market_rs_positive, coalesce(bullish AND pos_rs, false) AS context_eligible,
  CASE WHEN bullish IS NULL OR pos_rs IS NULL THEN 'unavailable' WHEN bullish AND pos_rs THEN 'eligible' ELSE 'filtered' END AS context_status, CASE WHEN complete THEN {r('net')} END AS net_return_pct FROM ce"""),
)
def _(spark, sf):
    c = context_events(spark, sf)
    return tidy(c.select("ticker", "split", "ts", "score", "market_regime_bullish", "market_rs_positive", "context_eligible", "context_status", "net_return_pct"))


RULE = cx.PolicyRule(minimum_validation_events=20, minimum_holdout_events=20, minimum_holdout_tickers=5, minimum_event_retention_pct=10.0, minimum_ticker_coverage_pct=30.0)
POLICIES = CONTEXT_EVENTS + """,
pv AS (SELECT ticker, split, net, unnest([{'p': 'off', 'k': true}, {'p': 'market_rs', 'k': coalesce(bullish AND pos_rs, false)}, {'p': 'market_regime', 'k': coalesce(bullish, false)}]) AS x FROM ce WHERE complete),
pt AS (SELECT split, x.p AS policy, ticker, count(*) AS a, count(*) FILTER (x.k) AS n, avg(net) FILTER (x.k) AS m FROM pv GROUP BY ALL),
pm AS (SELECT split, policy, sum(n) AS n, sum(n) / sum(a) * 100 AS ret, count(*) FILTER (n > 0) AS tk, count(*) FILTER (n > 0) / count(*) * 100 AS cov, avg(m) AS mt FROM pt GROUP BY ALL),
pe AS (SELECT split, x.p AS policy, avg(net) AS mn, median(net) AS md, avg((net > 0)::INT) * 100 AS pos FROM pv WHERE x.k GROUP BY ALL),
pa AS (SELECT * FROM pm LEFT JOIN pe USING (split, policy)),
pj AS (SELECT p.policy, p.split, p.n, p.tk, p.ret >= 10 AND p.cov >= 30 AND p.mn > b.mn AND p.mt > b.mt AND p.md >= b.md AND p.pos >= b.pos - 2 AS better, p.mn > b.mn AS gains, p.mt - b.mt AS gain, p.ret >= 10 AS c1, p.cov >= 30 AS c2, p.mt > b.mt AS c4, p.md >= b.md AS c5, p.pos >= b.pos - 2 AS c6
  FROM pa p JOIN pa b ON b.split = p.split AND b.policy = 'off' WHERE p.policy <> 'off'),
ps AS (SELECT v.policy, coalesce(d.gains AND v.n >= 20 AND v.better, false) AS qualifies, coalesce(v.gain, 0) AS gain FROM pj v JOIN pj d ON d.policy = v.policy AND d.split = 'development' WHERE v.split = 'validation')"""


def judged(spark, sf):
    """Complete events with the policies' flags, and the metrics per split and policy."""
    e = settle(context_events(spark, sf).filter("outcome_status = 'complete'"))
    flags = {"off": F.lit(True), "market_rs": F.col("context_eligible"), "market_regime": F.coalesce("market_regime_bullish", F.lit(False))}
    return e, flags, settle(cx.policy_metrics(e, flags, "net_return_pct"))


@query("policy_selection", with_(*SCORED, EVENTS, REGIME, POLICIES, select=f"SELECT policy, qualifies, {r('gain', 3)} AS validation_improvement, qualifies AND row_number() OVER (ORDER BY qualifies DESC, gain DESC, policy <> 'market_rs', policy) = 1 AS selected FROM ps"))
def _(spark, sf):
    """Every context policy's verdict on development and validation."""
    return tidy(cx.policy_selection(judged(spark, sf)[2], RULE, "market_rs"), 3)


@query("policy_holdout", with_(*SCORED, EVENTS, REGIME, POLICIES, """
ti AS (SELECT ticker, avg(net) FILTER (x.k) >= avg(net) AS up FROM pv WHERE x.p = 'market_rs' AND split = 'holdout' GROUP BY 1), tn AS (SELECT count(*) AS n, count(*) FILTER (up) AS u FROM ti)""", select="""
SELECT policy, concat_ws('|', CASE WHEN NOT coalesce(n >= 20, false) THEN 'events' END, CASE WHEN NOT coalesce(tk >= 5, false) THEN 'tickers' END, CASE WHEN NOT coalesce(c1, false) THEN 'retention' END, CASE WHEN NOT coalesce(c2, false) THEN 'ticker coverage' END,
  CASE WHEN NOT coalesce(gains, false) THEN 'mean return' END, CASE WHEN NOT coalesce(c4, false) THEN 'mean ticker return' END, CASE WHEN NOT coalesce(c5, false) THEN 'median return' END, CASE WHEN NOT coalesce(c6, false) THEN 'positive rate' END,
  CASE WHEN tk = 1 THEN 'more than one ticker' END, CASE WHEN (SELECT n > 0 AND u < n / 2 FROM tn) THEN 'half of the tickers improved' END) AS failures FROM pj WHERE policy = 'market_rs' AND split = 'holdout'"""))
def _(spark, sf):
    """The holdout test of the relative-strength policy."""
    e, flags, metrics = judged(spark, sf)
    tickers = cx.ticker_comparison(e.filter("split = 'holdout'"), flags["market_rs"], "net_return_pct")
    return tidy(cx.holdout_verdict(metrics, tickers, "market_rs", RULE).select("policy", "failures"))


@query("policy_ticker_comparison", with_(*SCORED, EVENTS, REGIME, POLICIES, select=f"SELECT ticker, count(*) AS baseline_events, count(*) FILTER (x.k) AS candidate_events, {r('avg(net)', 3)} AS baseline_mean_pct, {r('avg(net) FILTER (x.k)', 3)} AS candidate_mean_pct, coalesce(avg(net) FILTER (x.k) >= avg(net), false) AS improved FROM pv WHERE x.p = 'market_rs' AND split = 'holdout' GROUP BY 1"))
def _(spark, sf):
    """Holdout events of every ticker with and without the policy."""
    e, flags, _ = judged(spark, sf)
    return tidy(cx.ticker_comparison(e.filter("split = 'holdout'"), flags["market_rs"], "net_return_pct"), 3)


GATED = [DAILY, numbered(), indicators(), short_scores("ind", "sc0"), REGIME, """
sc AS MATERIALIZED (
  SELECT s.* REPLACE (CASE WHEN g.bullish AND q.pos_rs THEN s.score ELSE 0 END AS score) FROM sc0 s LEFT JOIN regime g ON g.ts = s.ts LEFT JOIN rs q ON q.ticker = s.ticker AND q.ts = s.ts)"""]


def gated(spark, sf):
    bars, proxies, mapping = market_parts(spark, sf)
    scored = settle(bt.scored_bars(bars))
    context = cs.with_market_context(scored.select("ticker", "ts"), settle(cx.regimes(proxies)), settle(cx.relative_strength(bars, proxies, mapping)))
    return scored, settle(cs.gated_scores(scored, context))


@query(
    "gated_backtest_trades",
    with_(*GATED, BACKTEST, select=f"SELECT ticker, {day('ts')} AS signal_time, {day('xts')} AS exit_time, score::BIGINT AS score, reason AS exit_reason, {r('(factor - 1) * 100', 3)} AS net_return_pct FROM tr"),
)
def _(spark, sf):
    _, g = gated(spark, sf)
    t = bt.run_backtest(None, BT, scored=g)["trades"]
    return tidy(t.select("ticker", "signal_time", "exit_time", "score", "exit_reason", "net_return_pct"), 3)


HOLDOUT = next(x for x in SPLITS if x.name == "holdout")
WARMUP = 60


def paired(spark, sf):
    """Both backtests over the holdout window and its warmup alone, every ticker."""
    bars, proxies, mapping = market_parts(spark, sf)
    window = settle(cs.holdout_bars(bars, HOLDOUT, WARMUP))
    scored = settle(bt.scored_bars(window))
    context = cs.with_market_context(scored.select("ticker", "ts"), settle(cx.regimes(proxies)), settle(cx.relative_strength(bars, proxies, mapping)))
    return settle(cs.paired_backtests(scored, settle(cs.gated_scores(scored, context)), dataclasses.replace(BT, warmup_bars=WARMUP)))


@query("paired_backtests")
def _(spark, sf):
    """Ungated and gated backtest of every ticker side by side, in the holdout window."""
    return paired(spark, sf)


@query("executable_gate")
def _(spark, sf):
    """The verdict over all tickers: medians, means, drawdown tolerance, with the reasons of a failure."""
    return cs.executable_gate(paired(spark, sf))
