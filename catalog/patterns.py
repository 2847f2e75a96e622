"""Pattern mining, fingerprints, matching and the point-in-time pattern study."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.config import PATTERN_PROFILES, SIMILARITY_WEIGHTS
from barloom.plans import patterns as pt
from barloom.session import settle
from barloom.sources import bars as src
from oracle.sql import DAILY, day, indicators, numbered, r, with_

from .base import query, rnd, tidy
from .bars import recent
from .studies import SPLITS, split_sql

STANDARD = PATTERN_PROFILES["standard"]
VOLATILE = PATTERN_PROFILES["volatile"]
HOLD, THRESHOLD = 5, 60.0


def rnd_even(x, d):
    return f"(round_even(({x}) * 1e{d}, 0) / 1e{d})"


def frame_sql(required, keys="ticker", name="f"):
    cond = " AND ".join(f"{c} IS NOT NULL" for c in required)
    return f"""
{name} AS MATERIALIZED (
  SELECT * EXCLUDE (pos, pc), row_number() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS pos FROM ind WHERE {cond})"""


def mined_sql(up, down, first, src="f", name="mined"):
    return f"""
{name}_c AS MATERIALIZED (
  SELECT a.ticker, a.pos, a.ts, k.event_type, (z.close - a.close) / a.close * 100 AS move
  FROM {src} a JOIN {src} z ON z.ticker = a.ticker AND z.pos = a.pos + 5 CROSS JOIN (SELECT unnest(['runup', 'decline']) AS event_type) k
  WHERE a.pos >= {first} AND ((event_type = 'runup' AND (z.close - a.close) / a.close * 100 >= {up}) OR (event_type = 'decline' AND (z.close - a.close) / a.close * 100 <= -{down}))),
{name}_w AS (
  SELECT ticker, event_type, -1::BIGINT AS pos, 0::BIGINT AS free, false AS taken FROM (SELECT DISTINCT ticker FROM {src}) CROSS JOIN (SELECT unnest(['runup', 'decline']) AS event_type)
  UNION ALL
  SELECT w.ticker, w.event_type, w.pos + 1, CASE WHEN c.pos >= w.free THEN c.pos + 5 ELSE w.free END, coalesce(c.pos >= w.free, false)
  FROM {name}_w w JOIN {src} f ON f.ticker = w.ticker AND f.pos = w.pos + 1
  LEFT JOIN {name}_c c ON c.ticker = w.ticker AND c.event_type = w.event_type AND c.pos = w.pos + 1),
{name} AS MATERIALIZED (
  SELECT c.* FROM {name}_c c JOIN {name}_w w ON w.ticker = c.ticker AND w.event_type = c.event_type AND w.pos = c.pos AND w.taken WHERE c.pos >= 10)"""


def points_sql(events, src, name, with_atr=True):
    """Normalised series points of the ten rows before each event."""
    series = ["price_pct", "volume_ratio", "rsi", "macd_diff", "bb_width"] + (["atr"] if with_atr else [])
    expr = {"price_pct": rnd_even("(close / base - 1) * 100", 4), "volume_ratio": rnd_even("volume / vavg", 4), "rsi": rnd_even("rsi", 2),
            "macd_diff": rnd_even("macd_diff", 4), "bb_width": rnd_even("bb_width", 4), "atr": rnd_even("atr", 4)}
    union = "\nUNION ALL\n".join(f"SELECT ticker, event_type, event_ts, idx, '{s}' AS series, {expr[s]} AS value FROM {name}_r" for s in series)
    return f"""
{name}_r AS MATERIALIZED (
  SELECT e.ticker, e.event_type, e.ts AS event_ts, 10 - (e.pos - x.pos) AS idx, x.close, x.volume, x.rsi, x.macd_diff, x.bb_width, x.atr,
    first(x.close) OVER (PARTITION BY e.ticker, e.event_type, e.pos ORDER BY x.pos) AS base, avg(x.volume) OVER (PARTITION BY e.ticker, e.event_type, e.pos) AS vavg
  FROM {events} e JOIN {src} x ON x.ticker = e.ticker AND x.pos BETWEEN e.pos - 10 AND e.pos - 1),
{name} AS MATERIALIZED ({union})"""


COMPLETE = [DAILY, numbered(), indicators(), frame_sql(["ema_50", "macd_signal", "volume_ratio", "bb_width", "rsi"])]


def fp_sql(points, name="fp", rounded=False):
    a, b = (rnd_even("m", 4), rnd_even("s", 4)) if rounded else ("m", "s")
    return f"""
{name} AS MATERIALIZED (
  SELECT event_type, n_events, series, idx, {rnd_even('m', 4)} AS mean, {rnd_even('s', 4)} AS std, {rnd_even(f'{a} + {b}', 4)} AS upper, {rnd_even(f'{a} - {b}', 4)} AS lower
  FROM (SELECT event_type, series, idx, avg(value) AS m, stddev_pop(value) AS s FROM {points} GROUP BY ALL)
  JOIN (SELECT event_type, count(DISTINCT (ticker, event_ts)) AS n_events FROM {points} GROUP BY 1 HAVING count(DISTINCT (ticker, event_ts)) >= 20) USING (event_type))"""


@query(
    "pattern_events",
    with_(*COMPLETE, mined_sql(15, 12, 0), select=f"SELECT ticker, event_type, {day('ts')} AS event_date, {rnd_even('move', 2)} AS move_pct FROM mined"),
)
def _(spark, sf):
    ev = pt.mine_events(pt.complete_frame(src.daily_bars(spark, sf)), STANDARD)
    return tidy(ev.select("ticker", "event_type", "event_date", "move_pct"))


@query(
    "pattern_fingerprints",
    with_(*COMPLETE, mined_sql(30, 25, 0), points_sql("mined", "f", "p"), fp_sql("p"),
          select=f"SELECT event_type, n_events, series, idx::BIGINT AS idx, {r('mean', 3)} AS mean, {r('std', 3)} AS std, {r('upper', 3)} AS upper, {r('lower', 3)} AS lower FROM fp"),
)
def _(spark, sf):
    ev = pt.mine_events(pt.complete_frame(src.daily_bars(spark, sf)), VOLATILE)
    return tidy(pt.fingerprint_points(settle(ev), VOLATILE), 3)


def similarity_sql(windows, fp, name, keys):
    """Correlation by aggregate over unnested windows: needs (keys, idx, five series, base, vavg)."""
    expr = {"price_pct": rnd_even("(close / base - 1) * 100", 4), "volume_ratio": rnd_even("volume / vavg", 4), "rsi": rnd_even("rsi", 2),
            "macd_diff": rnd_even("macd_diff", 4), "bb_width": rnd_even("bb_width", 4)}
    union = "\nUNION ALL\n".join(f"SELECT {keys}, idx, '{s}' AS series, {e} AS v FROM {windows}" for s, e in expr.items())
    terms = " + ".join(f"max(score) FILTER (series = '{s}') * {w}e0" for s, w in SIMILARITY_WEIGHTS.items())
    weighted = f"(0e0 + {terms}) / {sum(SIMILARITY_WEIGHTS.values())!r}::DOUBLE"
    out = ", ".join(f"max(score) FILTER (series = '{s}') AS score_{s}" for s in SIMILARITY_WEIGHTS)
    return f"""
{name}_v AS ({union}),
{name}_s AS MATERIALIZED (
  SELECT {keys}, event_type, n_events, series,
    coalesce(CASE WHEN stddev_pop(v) > 0 AND stddev_pop(mean) > 0 THEN {rnd_even('(corr(v, mean) + 1) / 2 * 100', 1)} END, 0) AS score
  FROM {name}_v JOIN {fp} USING (series, idx) GROUP BY {keys}, event_type, n_events, series),
{name} AS MATERIALIZED (
  SELECT {keys}, event_type, n_events AS fp_events, {out}, {rnd_even(weighted, 1)} AS similarity_score
  FROM {name}_s GROUP BY {keys}, event_type, n_events)"""


LIVE = f"""
{recent('bars', 60, 'rb')}, {numbered('rb', 'rbn')}, {indicators('rbn', 'rind')},
live AS MATERIALIZED (
  SELECT *, first(close) OVER (PARTITION BY ticker ORDER BY pos) AS base, avg(volume) OVER (PARTITION BY ticker) AS vavg, row_number() OVER (PARTITION BY ticker ORDER BY pos) - 1 AS idx
  FROM (SELECT * FROM rind WHERE ema_50 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) <= 10)
  QUALIFY count(*) OVER (PARTITION BY ticker) = 10)"""
SCORE_OUT = ", ".join(f"score_{s}" for s in SIMILARITY_WEIGHTS)


@query(
    "pattern_match_screen",
    with_(*COMPLETE, mined_sql(30, 25, 0), points_sql("mined", "f", "p"), fp_sql("p"), LIVE, similarity_sql("live", "fp", "sim", "ticker"), select=f"""
SELECT ticker, event_type, similarity_score, fp_events, {SCORE_OUT},
  CASE WHEN similarity_score >= 90 THEN 'very strong' WHEN similarity_score >= 70 THEN 'strong' WHEN similarity_score >= 60 THEN 'moderate' ELSE 'weak' END AS match_tier
FROM sim WHERE similarity_score >= 40"""),
)
def _(spark, sf):
    bars = src.daily_bars(spark, sf)
    ev = settle(pt.mine_events(pt.complete_frame(bars), VOLATILE))
    m = pt.match_screen(bars, pt.fingerprint_points(ev, VOLATILE), VOLATILE, min_similarity=40.0)
    return tidy(m.drop("interpretation"))


SPLIT_FRAME = [
    DAILY,
    f"tagged AS MATERIALIZED (SELECT *, {split_sql('ts')} AS split FROM bars WHERE {split_sql('ts')} IS NOT NULL)",
    numbered("tagged", "b", "ticker, split"), indicators("b", "ind", "ticker, split"),
    frame_sql(["rsi", "macd_diff", "bb_width"], "ticker, split", "sfr"),
    "f AS MATERIALIZED (SELECT * FROM sfr WHERE split = 'development')",
    mined_sql(30, 25, 10), points_sql("mined", "f", "p", with_atr=False), fp_sql("p", rounded=True),
]
NET = lambda s: (
    f"CASE WHEN event_type = 'runup' THEN (xc * (1 - {s}e-4) - eo * (1 + {s}e-4)) / (eo * (1 + {s}e-4)) * 100 "
    f"ELSE (eo * (1 - {s}e-4) - xc * (1 + {s}e-4)) / (eo * (1 - {s}e-4)) * 100 END"
)
OBS = f"""
dec AS MATERIALIZED (
  SELECT d.ticker, d.split, d.pos, d.ts, x.pos - d.pos + 9 AS idx, x.close, x.volume, x.rsi, x.macd_diff, x.bb_width,
    first(x.close) OVER (PARTITION BY d.ticker, d.split, d.pos ORDER BY x.pos) AS base, avg(x.volume) OVER (PARTITION BY d.ticker, d.split, d.pos) AS vavg
  FROM sfr d JOIN sfr x ON x.ticker = d.ticker AND x.split = d.split AND x.pos BETWEEN d.pos - 9 AND d.pos
  WHERE d.split IN ('validation', 'holdout') AND d.pos >= 9),
{similarity_sql('dec', 'fp', 'sim', 'ticker, split, pos')},
obs AS MATERIALIZED (
  SELECT s.*, f0.ts, f1.open AS eo, f1.ts AS ets, f5.close AS xc, f5.ts AS xts, s.similarity_score >= {THRESHOLD} AS q
  FROM sim s JOIN sfr f0 ON f0.ticker = s.ticker AND f0.split = s.split AND f0.pos = s.pos
  LEFT JOIN sfr f1 ON f1.ticker = s.ticker AND f1.split = s.split AND f1.pos = s.pos + 1
  LEFT JOIN sfr f5 ON f5.ticker = s.ticker AND f5.split = s.split AND f5.pos = s.pos + {HOLD})"""


def study(spark, sf):
    frame = settle(pt.split_frame(src.daily_bars(spark, sf), SPLITS))
    events = settle(pt.development_events(frame, VOLATILE))
    points = settle(pt.fingerprint_points(events, VOLATILE, tuple(SIMILARITY_WEIGHTS), from_rounded=True))
    return events, points, settle(pt.observations(frame, points, VOLATILE, HOLD, THRESHOLD))


@query(
    "pattern_development_fingerprints",
    with_(*SPLIT_FRAME, select=f"SELECT event_type, n_events, series, idx::BIGINT AS idx, {r('mean', 3)} AS mean, {r('std', 3)} AS std FROM fp"),
)
def _(spark, sf):
    frame = pt.split_frame(src.daily_bars(spark, sf), SPLITS)
    points = pt.fingerprint_points(settle(pt.development_events(frame, VOLATILE)), VOLATILE, tuple(SIMILARITY_WEIGHTS), from_rounded=True)
    return tidy(points.drop("upper", "lower"), 3)


@query(
    "pattern_observations",
    with_(*SPLIT_FRAME, OBS, select=f"""
SELECT ticker, split, event_type, {day('ts')} AS decision_date, similarity_score, q AS is_qualifying, CASE WHEN xc IS NOT NULL THEN 'complete' ELSE 'insufficient_future_bars' END AS outcome_status,
  CASE WHEN xc IS NOT NULL THEN {day('ets')} END AS entry_date, CASE WHEN xc IS NOT NULL THEN {day('xts')} END AS exit_date,
  CASE WHEN xc IS NOT NULL THEN {r(rnd_even(NET(5), 4))} END AS net_return_pct_5bps FROM obs"""),
)
def _(spark, sf):
    o = study(spark, sf)[2]
    return tidy(o.select("ticker", "split", "event_type", "decision_date", "similarity_score", "is_qualifying", "outcome_status", "entry_date", "exit_date", "net_return_pct_5bps"))


TRADES = f"""
rdy AS MATERIALIZED (SELECT * FROM obs WHERE q AND xc IS NOT NULL),
tw AS (
  SELECT DISTINCT ticker, split, event_type, -1::BIGINT AS pos, 0::BIGINT AS free, false AS taken FROM rdy
  UNION ALL
  SELECT w.ticker, w.split, w.event_type, w.pos + 1, CASE WHEN c.pos >= w.free THEN c.pos + {HOLD} ELSE w.free END, coalesce(c.pos >= w.free, false)
  FROM tw w JOIN sfr f ON f.ticker = w.ticker AND f.split = w.split AND f.pos = w.pos + 1
  LEFT JOIN rdy c ON c.ticker = w.ticker AND c.split = w.split AND c.event_type = w.event_type AND c.pos = w.pos + 1),
trd AS MATERIALIZED (SELECT c.* FROM rdy c JOIN tw w ON w.ticker = c.ticker AND w.split = c.split AND w.event_type = c.event_type AND w.pos = c.pos AND w.taken)"""


@query("pattern_trades", with_(*SPLIT_FRAME, OBS, TRADES, select=f"SELECT ticker, split, event_type, {day('ts')} AS decision_date, {day('xts')} AS exit_date, {r(rnd_even(NET(0), 4))} AS net_return_pct_0bps FROM trd"))
def _(spark, sf):
    t = pt.executable_trades(study(spark, sf)[2], HOLD)
    return tidy(t.select("ticker", "split", "event_type", "decision_date", "exit_date", "net_return_pct_0bps"))


Q5 = ", ".join(f"{r(f'quantile_cont({rnd_even(NET(5), 4)}, {q})', 7)} AS p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))


@query(
    "pattern_returns_distribution",
    with_(*SPLIT_FRAME, OBS, select=f"SELECT split, event_type, count(*) AS count, {r(f'avg({rnd_even(NET(5), 4)})', 7)} AS mean, {r(f'avg((({NET(5)}) > 0)::INT) * 100', 7)} AS win_rate_pct, {Q5} FROM obs WHERE xc IS NOT NULL GROUP BY 1, 2"),
)
def _(spark, sf):
    return tidy(pt.returns_distribution(study(spark, sf)[2], ["split", "event_type"], "net_return_pct_5bps"), 7)


@query(
    "pattern_signal_overlap",
    with_(*SPLIT_FRAME, OBS, select=f"""
SELECT split, event_type, count(*) AS signals, count(*) FILTER (nxt < pos + {HOLD}) AS overlapping
FROM (SELECT *, lead(pos) OVER (PARTITION BY ticker, split, event_type ORDER BY pos) AS nxt FROM obs WHERE q AND xc IS NOT NULL) GROUP BY 1, 2"""),
)
def _(spark, sf):
    o = study(spark, sf)[2].filter("is_qualifying AND outcome_status = 'complete'")
    return pt.overlap_counts(o.select("ticker", "split", "event_type", "pos", "decision_date"), HOLD)


@query(
    "pattern_baseline_comparison",
    with_(*SPLIT_FRAME, OBS, select=f"""
SELECT split, event_type, CASE WHEN grouping(ticker) = 1 THEN 'ALL' ELSE ticker END AS ticker, count(*) AS count, {r(f'avg({NET(0)})', 3)} AS mean_return_pct, {r(f'avg((({NET(0)}) > 0)::INT) * 100', 3)} AS positive_pct
FROM obs WHERE xc IS NOT NULL GROUP BY GROUPING SETS ((split, event_type), (split, event_type, ticker))"""),
)
def _(spark, sf):
    return tidy(pt.pooled_and_ticker_rows(study(spark, sf)[2], "net_return_pct_0bps"), 3)


@query(
    "pattern_matched_control_counts",
    with_(*SPLIT_FRAME, OBS, select="""
SELECT ticker, split, event_type, year, least(sig, pool)::BIGINT AS controls, pool < sig AS underfilled FROM (
  SELECT ticker, split, event_type, year(ts) AS year, count(*) FILTER (q) AS sig, count(*) FILTER (NOT q) AS pool FROM obs WHERE xc IS NOT NULL GROUP BY ALL) WHERE least(sig, pool) > 0"""),
)
def _(spark, sf):
    c = pt.matched_controls(study(spark, sf)[2], seed=7)
    return tidy(c.groupBy("ticker", "split", "event_type", "year").agg(F.count(F.lit(1)).alias("controls"), F.first("underfilled").alias("underfilled")))


V5 = rnd_even(NET(5), 4)
TICKER_ROWS = f"""
ob2 AS MATERIALIZED (SELECT *, CASE WHEN xc IS NOT NULL THEN {V5} END AS v, CASE WHEN xc IS NOT NULL THEN {rnd_even("CASE WHEN event_type = 'decline' THEN -(xc - eo) / eo * 100 ELSE (xc - eo) / eo * 100 END", 4)} END AS g FROM obs),
tk AS MATERIALIZED (
  SELECT split, event_type, ticker, count(*) AS n, count(*) FILTER (q AND v IS NOT NULL) AS k, sum(v) FILTER (q) AS s, avg(v) FILTER (q) AS m, avg(v) AS base, avg((v > 0)::INT) FILTER (q) AS win FROM ob2 GROUP BY ALL)"""


@query(
    "pattern_ticker_metrics",
    with_(*SPLIT_FRAME, OBS, TICKER_ROWS, select=f"SELECT split, event_type, ticker, n AS observations, k AS qualifying_signals, {r('m', 3)} AS mean_net_return_pct, {r('base', 3)} AS mean_baseline_return_pct, {r('win', 3)} AS win_rate, {r('(m - base) * 100', 2)} AS lift_bps FROM tk"),
)
def _(spark, sf):
    m = pt.ticker_metrics(study(spark, sf)[2], "net_return_pct_5bps")
    keys = ["split", "event_type", "ticker"]
    return tidy(m.drop("_sum", "lift_bps"), 3).join(tidy(m.select(*keys, "lift_bps"), 2), keys)


@query(
    "pattern_period_metrics",
    with_(*SPLIT_FRAME, OBS, TICKER_ROWS, """
hit AS MATERIALIZED (SELECT * FROM ob2 WHERE q AND v IS NOT NULL),
md AS (SELECT split, event_type, list_sort(list(DISTINCT ts))[len(list(DISTINCT ts)) // 2 + 1] AS mid FROM hit GROUP BY 1, 2)""",
        select=f"""
SELECT h.split, h.event_type, (SELECT count(*) FROM ob2 o WHERE o.split = h.split AND o.event_type = h.event_type) AS eligible_observations, (SELECT count(*) FROM ob2 o WHERE o.split = h.split AND o.event_type = h.event_type AND v IS NULL) AS missing_data_count,
  count(*) AS qualifying_signals, {day('min(ts)')} AS date_start, {day('max(ts)')} AS date_end, {r('avg(similarity_score)', 5)} AS mean_similarity, {r('avg(g)', 5)} AS mean_gross_return_pct, {r('avg(v)', 5)} AS mean_net_return_pct, {r('avg((v > 0)::INT)', 5)} AS win_rate,
  count(DISTINCT ticker) AS ticker_count, any_value(mc) AS max_ticker_concentration, any_value(cc) AS max_contribution_concentration, any_value(ml) AS median_ticker_lift_bps, any_value(pp) AS pct_tickers_positive_lift,
  {r('avg(v) FILTER (ts <= mid)', 5)} AS first_half_mean_return_pct, {r('avg(v) FILTER (ts > mid)', 5)} AS second_half_mean_return_pct,
  {", ".join(f"{r(f'quantile_cont(similarity_score, {x})', 5)} AS similarity_p{int(x * 100):02d}" for x in (0.05, 0.25, 0.5, 0.75, 0.95))}, {r('quantile_cont(v, 0.5)', 5)} AS median_net_return_pct
FROM hit h JOIN md USING (split, event_type) JOIN (
  SELECT split, event_type, {r('max(k) / sum(k)', 5)} AS mc, {r('max(abs(s)) / abs(sum(s))', 5)} AS cc, {r('median((m - base) * 100)', 2)} AS ml, {r('avg((m > base)::INT)', 5)} AS pp FROM tk GROUP BY 1, 2) t USING (split, event_type)
GROUP BY 1, 2"""),
)
def _(spark, sf):
    m = pt.period_metrics(study(spark, sf)[2], "net_return_pct_5bps")
    keys = ["split", "event_type"]
    return tidy(m.drop("median_ticker_lift_bps"), 5).join(tidy(m.select(*keys, "median_ticker_lift_bps"), 2), keys)
