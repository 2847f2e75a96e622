"""Verdicts of the weekly study and of context policies, and security classes, on rows made by hand."""
import pytest
from pyspark.sql import functions as F

from barloom.plans import alerts as al
from barloom.plans import context as cx
from barloom.plans import datasets as ds
from barloom.plans import history as hs
from barloom.plans import weekly as wk
from catalog.base import tidy

SPEC = wk.WeeklySpec(minimum_signals=10, minimum_stock_tickers=2, minimum_etf_tickers=1)
GOOD = dict(candidate_count=50, baseline_count=50, lift_pct=1.0, sensitivity_lift_pct=0.5, q10_lift_pct=-0.2, candidate_stock_tickers=3, candidate_etf_tickers=1,
            baseline_stock_tickers=3, baseline_etf_tickers=1, leading_stock_share=0.8, leading_etf_share=0.6)
EVIDENCE = "split string, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint'}" for k, v in GOOD.items())


def verdict(spark, hold=None, low=0.1, high=2.0, validation=0.4, absent=False):
    rows = [] if absent else [("holdout", *(GOOD | (hold or {})).values())]
    if validation is not None:
        rows.append(("validation", *(GOOD | {"lift_pct": validation}).values()))
    boot = spark.createDataFrame([("holdout", 13, low, high)], "split string, horizon int, ci_low double, ci_high double")
    return wk.conclusion(spark.createDataFrame(rows, EVIDENCE), boot, SPEC).first()["conclusion"]


@pytest.mark.parametrize("change, want", [
    ({}, "supports_further_research"),
    ({"high": 0.0, "low": -1.0}, "reject_or_deprioritize"),
    ({"hold": {"lift_pct": -0.5}}, "reject_or_deprioritize"),
    ({"hold": {"q10_lift_pct": -2.5, "lift_pct": 0.0}}, "reject_or_deprioritize"),
    ({"hold": {"q10_lift_pct": -2.5}}, "inconclusive"),
    ({"hold": {"lift_pct": 0.4}}, "inconclusive"),
    ({"hold": {"lift_pct": None}}, "inconclusive"),
    ({"low": 0.0}, "inconclusive"),
    ({"low": None, "high": None}, "inconclusive"),
    ({"hold": {"candidate_count": 9}}, "inconclusive"),
    ({"hold": {"baseline_etf_tickers": 0}}, "inconclusive"),
    ({"hold": {"sensitivity_lift_pct": 0.0}}, "inconclusive"),
    ({"hold": {"leading_etf_share": None}}, "inconclusive"),
    ({"validation": 0.0}, "inconclusive"),
    ({"validation": None}, "inconclusive"),
    ({"absent": True, "low": None, "high": None}, "inconclusive"),
])
def test_weekly_conclusion(spark, change, want):
    assert verdict(spark, **change) == want


def metrics(spark, rows):
    names = ["split", "policy", *cx.JUDGED]
    return spark.createDataFrame([dict(zip(names, r)) for r in rows], "split string, policy string, eligible_events bigint, tickers bigint, " + ", ".join(f"{m} double" for m in cx.JUDGED[2:]))


BASE = (200, 20, 100.0, 100.0, 1.0, 1.0, 0.5, 55.0)
RULE = cx.PolicyRule()


def test_policy_selection_prefers_validation_gain_then_the_simpler(spark):
    better = (120, 15, 60.0, 75.0, 1.2, 1.5, 0.5, 53.0)
    rows = [(s, "off", *BASE) for s in ("development", "validation", "holdout")]
    rows += [(s, p, *better) for s in ("development", "validation") for p in ("market_rs", "a_policy")]
    rows += [("development", "few", *better), ("validation", "few", 99, *better[1:]), ("development", "worse", *BASE), ("validation", "worse", *better), ("validation", "alone", *better)]
    got = {r.policy: (r.qualifies, r.selected) for r in cx.policy_selection(metrics(spark, rows), RULE, "market_rs").collect()}
    assert got == {"market_rs": (True, True), "a_policy": (True, False), "few": (False, False), "worse": (False, False), "alone": (False, False)}


def test_holdout_verdict_names_what_fails(spark):
    rows = [("holdout", "off", *BASE), ("holdout", "p", 90, 1, 20.0, 40.0, 0.9, 1.1, 0.4, 52.0)]
    tickers = spark.createDataFrame([(True,), (False,), (False,)], "improved boolean")
    got = cx.holdout_verdict(metrics(spark, rows), tickers, "p", RULE).first()
    assert got.failures == ["events", "tickers", "retention", "ticker coverage", "mean return", "median return", "positive rate", "more than one ticker", "half of the tickers improved"] and not got.passed
    fine = [("holdout", "off", *BASE), ("holdout", "p", 100, 10, 25.0, 50.0, 1.1, 1.1, 0.5, 53.0)]
    assert cx.holdout_verdict(metrics(spark, fine), tickers.filter("improved"), "p", RULE).first().passed


def test_security_classes(spark):
    rows = [
        ("Acme Inc", "CS", "stocks", "XNYS", None, None, "Common Stock", "common_stock"), ("Acme Inc", "CS", "stocks", "XNYS", None, None, "Ordinary", "unknown"), ("Acme", "CS", "stocks", "XNYS", None, None, "Common Stock", "unknown"),
        ("Acme Inc", "CS", "OTC", "XNYS", None, None, "Common Stock", "OTC"), ("Acme Inc", "CS", "stocks", None, None, None, "Common Stock", "OTC"), ("Acme Inc", "pfd", "stocks", "X", None, None, None, "preferred_stock"),
        ("Acme Inc", "CS", "stocks", "X", "6770", None, "Common Stock", "pre_merger_spac"), ("Acme Inc", "CS", "stocks", "X", "6799", None, "Common Stock", "shell_company"), ("Acme Inc", "CS", "stocks", "X", None, "Blank Checks", "Common Stock", "pre_merger_spac"),
        ("Preferred Stock ETF", "INDEX", "stocks", "X", None, None, None, "ETF"), ("Any", "FUND", "stocks", "X", None, None, None, "closed_end_fund"), ("Any", "FUND", "fx", "X", None, None, None, "other_structurally_incomparable_securities"),
        ("Income Fund", None, "stocks", "X", None, None, None, "closed_end_fund"), ("REIT fund", "INDEX", "stocks", "X", None, None, None, "unknown"), (None, None, None, "X", None, None, None, "unknown"),
    ]
    df = spark.createDataFrame(rows, "name string, code string, market string, exchange string, sic string, about string, common string, want string")
    out = df.withColumn("got", ds.security_class(*[F.col(c) for c in ("name", "code", "market", "exchange", "sic", "about", "common")]))
    assert [r.got for r in out.collect()] == [r[-1] for r in rows]


def test_malformed_alert_keys_are_kept_apart(spark):
    df = spark.createDataFrame([(" aa ", "Coil", "1D"), ("a b", "coil", "1d"), (None, "coil", "1d"), ("AA", "9x", "1d")], "ticker string, alert_type string, timeframe string")
    assert [tuple(r) for r in al.normalize_key(df).collect()] == [("AA", "coil", "1d")]
    assert al.normalize_key(df, malformed=True).count() == 3


def test_executable_gate_against_a_plain_version(spark):
    import numpy as np

    from barloom.plans.context_study import FAILURES, executable_gate

    cols = "ticker string, baseline_total_trades int, baseline_expectancy_pct double, baseline_total_return_pct double, baseline_max_drawdown_pct double, candidate_total_trades int, candidate_expectancy_pct double, candidate_total_return_pct double, candidate_max_drawdown_pct double"

    def plain(rows):
        both = [r for r in rows if r[1] is not None and r[5] is not None]
        if not both:
            return [FAILURES["none"]]
        some = [r for r in both if r[5] > 0]
        if not some:
            return [FAILURES["zero"]]
        col = lambda i: [r[i] for r in some if r[i] is not None]
        out = [FAILURES["one"]] if len(some) == 1 else []
        out += [FAILURES["median"]] if np.median(col(6)) <= np.median(col(2)) else []
        out += [FAILURES["mean"]] if np.mean(col(6)) <= np.mean(col(2)) else []
        out += [FAILURES["return"]] if np.median(col(7)) < np.median(col(3)) else []
        return out + ([FAILURES["drawdown"]] if np.median(col(8)) < np.median(col(4)) - 2 else [])

    rng = np.random.default_rng(2)
    row = lambda i: (f"t{i}", int(rng.integers(1, 9)), *map(float, rng.normal(size=2)), float(-rng.integers(1, 9)), int(rng.integers(0, 4)), *map(float, rng.normal(0.3, 1, size=2)), float(-rng.integers(1, 9)))
    cases = [[row(i) for i in range(n)] for n in (1, 2, 5, 9)]
    cases += [[], [("a", None, None, None, None, 3, 1.0, 1.0, -1.0)], [("a", 2, 1.0, 1.0, -1.0, 0, None, 0.0, 0.0)], [(f"t{i}", 3, 0.1 * i, 1.0, -3.0, 2, 0.1 * i + 0.2, 2.0, -4.5) for i in range(3)]]
    for rows in cases:
        got = executable_gate(spark.createDataFrame(rows, cols)).first()
        assert got.failure_reasons == plain(rows) and got.passed == (not plain(rows))
    assert got.passed


def test_holdout_bars_keep_their_warmup_alone(spark):
    import datetime as dt

    from barloom.config import Split
    from barloom.plans.context_study import holdout_bars

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = [("a", day(i), float(i)) for i in range(40)] + [("few", day(i), 1.0) for i in range(18, 30)] + [("none", day(i), 1.0) for i in range(5)]
    got = holdout_bars(spark.createDataFrame(rows, "ticker string, ts timestamp, close double"), Split("holdout", "2024-01-21", "2024-01-31"), 6).collect()
    assert sorted(r.close for r in got if r.ticker == "a") == [float(i) for i in range(15, 31)] and {r.ticker for r in got} == {"a"}


def test_outcome_figures_are_rounded_once(spark):
    """A mean of 96.448 shows as 96.4 at one digit; rounded to 96.45 before, it showed as 96.5."""
    rows = spark.createDataFrame([("long", 50, x, 1.0) for x in (96.44, 96.45, 96.46, 96.442)], "timeframe string, score int, outcome_pct double, outcome_close double")
    r = hs.outcome_stats(rows).first()
    assert r.avg_return_pct == pytest.approx(96.448, abs=1e-9) and tidy(hs.outcome_stats(rows), 1).first().avg_return_pct == 96.4


def test_equal_trades_of_both_rules_tie_in_any_order(spark):
    nets = [0.1, 0.2, 0.3, 1e16, -1e16, 0.7]
    rows = [("holdout", "A", "stock", rule, 13, "complete", x, x) for rule, values in (("candidate", nets), ("baseline", nets[::-1])) for x in values]
    trades = spark.createDataFrame(rows, "split string, ticker string, cohort string, rule string, horizon int, outcome_status string, net_return_pct_5bps double, net_return_pct_25bps double").coalesce(1)
    shares = {wk.split_evidence(t, wk.WeeklySpec()).first().leading_stock_share for t in (trades, trades.orderBy(F.desc("rule")), trades.orderBy("net_return_pct_5bps"))}
    lift = wk.rule_lift(trades, "net_return_pct_5bps").first().positive_fraction
    assert shares == {0.0} and lift == 0.0
