"""Controls, bootstrap intervals and gates of the pattern study."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import stats
from barloom.plans import pattern_evidence as pe
from barloom.plans import patterns as pt
from barloom.session import settle
from oracle.sql import bootstrap, day, r, with_

from .base import query, tidy
from .patterns import OBS, SPLIT_FRAME, TICKER_ROWS, study

VALUE = "net_return_pct_5bps"
SEED = 7
SPEC = pe.EvidenceSpec(minimum_validation_signals=60, minimum_holdout_signals=60, minimum_tickers=5, resamples=2_000)

CONTROLS = f"""
cc0 AS MATERIALIZED (
  SELECT *, year(ts) AS yr, count(*) FILTER (q) OVER cy AS sig, count(*) FILTER (NOT q) OVER cy AS pool,
    row_number() OVER (PARTITION BY ticker, split, event_type, year(ts), q ORDER BY md5('{SEED}:' || ticker || ':' || {day('ts')})) AS rk
  FROM ob2 WHERE v IS NOT NULL WINDOW cy AS (PARTITION BY ticker, split, event_type, year(ts))),
ctl AS MATERIALIZED (SELECT * FROM cc0 WHERE NOT q AND rk <= sig),
sides AS MATERIALIZED (
  SELECT split, event_type, coalesce(a.ticker, b.ticker) AS cluster, a.s, a.n, b.s AS os, b.n AS osn
  FROM (SELECT split, event_type, ticker, sum(v) AS s, count(*) AS n FROM ob2 WHERE q AND v IS NOT NULL GROUP BY ALL) a
  FULL JOIN (SELECT split, event_type, ticker, sum(v) AS s, count(*) AS n FROM ctl GROUP BY ALL) b USING (split, event_type, ticker))"""
PARTS = [*SPLIT_FRAME, OBS, TICKER_ROWS, CONTROLS]
MEAN_BOOT = bootstrap("(SELECT split, event_type, cluster, s, n FROM sides WHERE n > 0)", "split, event_type", ["s", "n"], SPEC.resamples, SPEC.seed, "mb")
LIFT_BOOT = bootstrap("(SELECT split, event_type, cluster, s, n, os, osn FROM sides WHERE n > 0 AND osn > 0)", "split, event_type", ["s", "n", "os", "osn"], SPEC.resamples, SPEC.seed, "lb")
MEANS = """
pm AS (SELECT split, event_type, sum(s) / sum(n) AS mean, count(*) AS tickers, sum(n)::BIGINT AS signals, max(n) / sum(n) AS conc FROM sides WHERE n > 0 GROUP BY 1, 2),
mi AS (SELECT split, event_type, quantile_cont(s / n, 0.025) AS lo, quantile_cont(s / n, 0.975) AS hi, count(*) AS reps FROM mb GROUP BY 1, 2)"""
LIFTS = """
pl AS (SELECT split, event_type, CASE WHEN count(*) FILTER (n > 0 AND osn > 0) > 0 THEN (sum(s) / sum(n) - sum(os) / sum(osn)) * 100 END AS lift, count(*) FILTER (n > 0 AND osn > 0) AS common FROM sides GROUP BY 1, 2),
li AS (SELECT split, event_type, quantile_cont((s / n - os / osn) * 100, 0.025) AS lo, quantile_cont((s / n - os / osn) * 100, 0.975) AS hi, count(*) AS reps FROM lb GROUP BY 1, 2)"""


def inputs(spark, sf):
    obs = study(spark, sf)[2]
    return obs, settle(pt.matched_controls(obs, SEED))


@query("pattern_matched_controls", with_(*PARTS, select=f"SELECT ticker, split, event_type, {day('ts')} AS decision_date, {r('v')} AS net_return_pct_5bps, pool < sig AS underfilled FROM ctl"))
def _(spark, sf):
    """The controls drawn, one by one."""
    return tidy(inputs(spark, sf)[1].select("ticker", "split", "event_type", "decision_date", VALUE, "underfilled"))


@query(
    "pattern_bootstrap",
    with_(*PARTS, MEAN_BOOT, MEANS, select=f"SELECT split, event_type, {r('mean')} AS estimate, tickers AS clusters, {r('lo')} AS ci_low, {r('hi')} AS ci_high, reps AS replicates FROM pm JOIN mi USING (split, event_type)"),
)
def _(spark, sf):
    """Interval of the mean return of qualifying observations under resampling of tickers."""
    obs, controls = inputs(spark, sf)
    sides = settle(pe.ticker_sides(obs, controls, VALUE).filter("n > 0"))
    return tidy(stats.cluster_bootstrap(sides, pe.CELL, "sum", "n", SPEC.resamples, SPEC.seed))


@query(
    "pattern_lift_bootstrap",
    with_(*PARTS, LIFT_BOOT, LIFTS, select=f"SELECT split, event_type, {r('lift', 3)} AS lift, common AS common_clusters, {r('lo', 3)} AS ci_low, {r('hi', 3)} AS ci_high, reps AS replicates FROM pl LEFT JOIN li USING (split, event_type)"),
)
def _(spark, sf):
    """Lift of signals over their matched controls in basis points, tickers of both sides drawn together."""
    sides = settle(pe.ticker_sides(*inputs(spark, sf), VALUE))
    return tidy(stats.lift_bootstrap(sides, pe.CELL, SPEC.resamples, SPEC.seed), 3)


EVIDENCE = f"""
uf AS (SELECT split, event_type, bool_or(p < s) AS under FROM (SELECT split, event_type, ticker, year(ts), count(*) FILTER (q) AS s, count(*) FILTER (NOT q) AS p FROM ob2 WHERE v IS NOT NULL GROUP BY ALL) GROUP BY 1, 2),
tl AS (SELECT split, event_type, round_even((s / n - os / osn) * 100, 6) AS l FROM sides WHERE n > 0 AND osn > 0),
tb AS (SELECT split, event_type, median(l) AS ml, avg((l > 0)::INT) AS pp FROM tl GROUP BY 1, 2),
hd AS (SELECT split, event_type, list_sort(list(DISTINCT ts))[len(list(DISTINCT ts)) // 2 + 1] AS mid FROM ob2 WHERE q AND v IS NOT NULL GROUP BY 1, 2),
hv AS (SELECT o.split, o.event_type, avg(v) FILTER (ts <= mid) AS h1, avg(v) FILTER (ts > mid) AS h2 FROM ob2 o JOIN hd ON hd.split = o.split AND hd.event_type = o.event_type WHERE q AND v IS NOT NULL GROUP BY 1, 2),
evd AS MATERIALIZED (
  SELECT uf.split, uf.event_type, under, coalesce(signals, 0) AS signals, coalesce(tickers, 0) AS tickers, conc, mean, mi.lo AS mlo, mi.hi AS mhi,
    CASE WHEN NOT under THEN lift END AS lift, CASE WHEN NOT under THEN li.lo END AS llo, CASE WHEN NOT under THEN li.hi END AS lhi, common, ml, pp, h1, h2
  FROM uf LEFT JOIN pm USING (split, event_type) LEFT JOIN mi USING (split, event_type) LEFT JOIN pl USING (split, event_type) LEFT JOIN li USING (split, event_type)
    LEFT JOIN tb USING (split, event_type) LEFT JOIN hv USING (split, event_type))"""
EVIDENCE_PARTS = [*PARTS, MEAN_BOOT, MEANS, LIFT_BOOT, LIFTS, EVIDENCE]


@query(
    "pattern_evidence",
    with_(*EVIDENCE_PARTS, select=f"""
SELECT split, event_type, under AS controls_underfilled, signals AS qualifying_signals, tickers AS ticker_count, {r('conc', 3)} AS max_ticker_concentration, {r('mean', 3)} AS mean_net_return_pct, {r('mlo', 3)} AS mean_ci_low, {r('mhi', 3)} AS mean_ci_high,
  {r('lift', 3)} AS lift_bps, {r('llo', 3)} AS lift_ci_low, {r('lhi', 3)} AS lift_ci_high, common AS common_clusters, {r('pp', 3)} AS pct_tickers_positive_lift, {r('ml', 3)} AS median_ticker_lift_bps, {r('h1', 3)} AS first_half_mean_return_pct, {r('h2', 3)} AS second_half_mean_return_pct FROM evd"""),
)
def _(spark, sf):
    return tidy(pe.evidence(*inputs(spark, sf), VALUE, SPEC), 3)


def gate_sql():
    """Every gate as a select over both splits' rows of an event type."""
    rows = []
    add = lambda name, kind, value, test: rows.append(f"SELECT event_type, '{name}' AS gate, '{kind}' AS kind, ({value})::DOUBLE AS value, coalesce({test}, false) AS passed FROM both_splits")
    for s, p in (("validation", "v"), ("holdout", "h")):
        add(f"{s}_signals", "sample", f"coalesce({p}.signals, 0)", f"{p}.signals >= 60")
        add(f"{s}_tickers", "sample", f"coalesce({p}.tickers, 0)", f"{p}.tickers >= 5")
        add(f"{s}_max_ticker_concentration", "sample", f"{p}.conc", f"{p} IS NOT NULL AND ({p}.conc IS NULL OR {p}.conc <= 0.2)")
        add(f"{s}_controls_underfilled", "sample", f"coalesce({p}.under, false)::INT", f"NOT {p}.under")
        for name, c, least in (("mean_net_return_positive", "mean", "> 0"), ("mean_ci_above_zero", "mlo", "> 0"), ("lift_threshold", "lift", ">= 25"), ("lift_ci_above_zero", "llo", "> 0"),
                               ("median_ticker_lift_positive", "ml", "> 0"), ("pct_tickers_positive_lift", "pp", ">= 0.55")):
            add(f"{s}_{name}", "return", f"{p}.{c}", f"{p}.{c} {least}")
        if s == "holdout":
            add("holdout_first_half_positive", "return", "h.h1", "h.h1 > 0")
            add("holdout_second_half_positive", "return", "h.h2", "h.h2 > 0")
    return f"""
both_splits AS (SELECT e.event_type, (SELECT x FROM evd x WHERE x.split = 'validation' AND x.event_type = e.event_type) AS v, (SELECT x FROM evd x WHERE x.split = 'holdout' AND x.event_type = e.event_type) AS h
  FROM (SELECT unnest(['runup', 'decline']) AS event_type) e),
gt AS MATERIALIZED ({' UNION ALL '.join(rows)}),
cl AS MATERIALIZED (SELECT event_type, CASE WHEN NOT bool_and(passed) FILTER (kind = 'sample') THEN 'inconclusive' WHEN bool_and(passed) FILTER (kind = 'return') THEN 'supported'
  WHEN count(*) FILTER (kind = 'return' AND value IS NULL) > 0 THEN 'inconclusive' ELSE 'rejected' END AS classification FROM gt GROUP BY 1)"""


@query(
    "pattern_gates",
    with_(*EVIDENCE_PARTS, gate_sql(), select=f"""
SELECT event_type, gate, {r('value', 3)} AS value, passed, passed = false AS has_reason, classification,
  (SELECT CASE WHEN bool_or(classification = 'rejected') THEN 'rejected' WHEN bool_or(classification = 'inconclusive') THEN 'inconclusive' ELSE 'supported' END FROM cl) AS overall FROM gt JOIN cl USING (event_type)"""),
)
def _(spark, sf):
    """All gates of both event types, the classification of each and of the study."""
    gates = pe.evidence_gates(pe.evidence(*inputs(spark, sf), VALUE, SPEC), SPEC)
    return tidy(gates.withColumn("has_reason", F.col("reason").isNotNull()).drop("reason"), 3)
