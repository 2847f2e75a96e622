"""Gates and metrics of the session study, the pattern gates, and grids with planted gaps, against plain versions."""
import pytest
from pyspark.sql import functions as F

from barloom.plans import pattern_evidence as pe
from barloom.plans import session_study as ss
from barloom.plans.intraday import SessionSpec
from barloom.session import settle

MIN = ss.SampleMinimums(trades=4, stock_symbols=2, etf_symbols=1, stock_trades=2, etf_trades=1, overlap=2, max_pct_of_trades=60.0, max_pct_of_profit=100.0)
SIGNAL = "strategy string, scenario string, ticker string, is_etf boolean, session_date date, signal_idx int, status string, exit_type string, net_r double, holding_minutes double, opening_gap double, month string, gap_bucket string"


def signal_rows(candidate, a, b, dear=None):
    """Rows per strategy from {ticker: [R, ...]}; tickers beginning with e are ETFs."""
    import datetime as dt

    out = []
    for strategy, scenario, side in (("candidate", "base", candidate), ("baseline_a", "base", a), ("baseline_b", "base", b), ("candidate", "stress", candidate if dear is None else dear)):
        for ticker, results in side.items():
            for i, r in enumerate(results):
                done = r is not None
                out.append((strategy, scenario, ticker, ticker.startswith("e"), dt.date(2024, 1, 1 + i), 1, "executed" if done else "no_signal", "stop" if done else None, r, 5.0 if done else None, None, "2024-01", "unknown"))
    return out


def outcome(spark, rows, short=(), broken=()):
    signals = settle(ss.grouped(spark.createDataFrame(rows, SIGNAL), "base"))
    trades = settle(ss.finite_trades(signals))
    symbols = settle(ss.per_symbol_metrics(trades, ss.CELL))
    metrics = settle(ss.study_metrics(signals, symbols, trades).filter("grouping = 'all'"))
    data = spark.createDataFrame([(list(broken), list(short))], "contract_reasons array<string>, sufficiency_reasons array<string>")
    gates = ss.evaluate_gates(metrics, ss.paired_outperformance(symbols.filter("grouping = 'all'"), "candidate", "baseline_a"), data, "base", "stress", MIN)
    rows = gates.collect()
    return rows[0].disposition, rows[0].disposition_reason, {r.gate.split("_")[0]: (r.passed, r.reason) for r in rows}, metrics


GOOD = {"s1": [1.0, 0.5, -0.2], "s2": [0.6, -0.1], "e1": [0.4, 0.3, -0.1]}
WEAK = {"s1": [0.1, -0.4], "s2": [-0.3], "e1": [-0.2]}


def test_gates_support_a_better_candidate(spark):
    disposition, why, gates, _ = outcome(spark, signal_rows(GOOD, WEAK, WEAK))
    assert disposition == "supported" and why == "all_gates_passed" and len(gates) == 12
    assert gates["8"] == (True, "paired_overlap=3_outperform_rate=1.0000")


def test_gates_name_what_failed(spark):
    disposition, why, gates, _ = outcome(spark, signal_rows(GOOD, GOOD, WEAK, dear={"s1": [-1.0]}))
    assert disposition == "not_supported" and not gates["3"][0] and not gates["11"][0] and not gates["8"][0]
    assert why == "gates_failed: 3_candidate_median_expectancy_vs_baseline_a, 8_paired_symbol_outperformance_vs_baseline_a, 11_candidate_pooled_expectancy_nonneg_10bps"


def test_gates_that_cannot_be_computed_are_null(spark):
    disposition, why, gates, _ = outcome(spark, signal_rows(GOOD, {"s1": [None]}, WEAK))
    assert disposition == "inconclusive" and why == "required_gate_not_computable"
    assert gates["3"] == (None, "median_per_symbol_expectancy_not_computable") and gates["8"] == (None, "paired_overlap_0_below_2") and gates["6"][0] is None


def test_samples_and_contract_come_first(spark):
    disposition, why, gates, _ = outcome(spark, signal_rows({"s1": [1.0, 1.0], "e1": [0.2, 0.2]}, WEAK, WEAK), short=["missing_bar_rate_above_5% (2 symbol-months)"])
    assert disposition == "inconclusive" and gates["1"] == (False, why.split(": ", 1)[1])
    assert gates["1"][1] == "represented_stock_symbols_1_below_2; data_sufficiency_failed; missing_bar_rate_above_5% (2 symbol-months)"
    disposition, why, gates, _ = outcome(spark, signal_rows(GOOD, WEAK, WEAK), broken=["s1:off_grid_bars=3"])
    assert disposition == "invalid" and why == "s1:off_grid_bars=3" and list(gates) == ["1"]


def test_unbounded_profit_factors_rank_above_all(spark):
    """Two of three symbols without a loss: the median is unbounded, its value null; symbols without finite results do not count."""
    rows = signal_rows({"s1": [1.0], "s2": [2.0, 1.0], "e1": [1.0, -1.0], "s3": [float("nan")]}, WEAK, WEAK)
    _, _, gates, metrics = outcome(spark, rows)
    m = metrics.filter("strategy = 'candidate' AND scenario = 'base'").first()
    assert m.represented_symbols == 3 and m.total_trades == 6 and m.median_per_symbol_profit_factor_order == float("inf") and m.median_per_symbol_profit_factor_value is None
    assert gates["5"] == (True, "median_pf_order=inf") and gates["6"][0] is True


def test_eligibility(spark):
    rows = [("a", True, 10.0, 1e8, "common_stock", False), ("b", False, 1.0, 1.0, "Warrant", False), ("c", True, None, None, "etf", True)]
    meta = spark.createDataFrame(rows, "ticker string, is_eligible boolean, prior_close double, median_dollar_volume double, security_type string, is_etf boolean")
    got = {r.ticker: (r.eligible, list(r.reasons)) for r in ss.eligibility(meta, SessionSpec()).collect()}
    assert got["a"] == (True, []) and got["c"] == (True, [])
    assert got["b"] == (False, ["ticker_not_eligible", "prior_close_below_min", "prior_20_median_dollar_volume_below_threshold", "security_type_excluded_Warrant"])


FOUND = "split string, event_type string, controls_underfilled boolean, qualifying_signals bigint, ticker_count bigint, max_ticker_concentration double, mean_net_return_pct double, mean_ci_low double, lift_bps double, lift_ci_low double, median_ticker_lift_bps double, pct_tickers_positive_lift double, first_half_mean_return_pct double, second_half_mean_return_pct double"


@pytest.mark.parametrize("change, want", [
    ({}, "supported"), ({"mean_ci_low": -0.1}, "rejected"), ({"lift_bps": 24.9}, "rejected"), ({"lift_ci_low": None}, "inconclusive"), ({"qualifying_signals": 99}, "inconclusive"),
    ({"controls_underfilled": True}, "inconclusive"), ({"max_ticker_concentration": None}, "supported"), ({"max_ticker_concentration": 0.21}, "inconclusive"),
])
def test_pattern_gates(spark, change, want):
    good = {"controls_underfilled": False, "qualifying_signals": 100, "ticker_count": 15, "max_ticker_concentration": 0.2, "mean_net_return_pct": 0.5, "mean_ci_low": 0.1, "lift_bps": 25.0, "lift_ci_low": 1.0,
            "median_ticker_lift_bps": 3.0, "pct_tickers_positive_lift": 0.55, "first_half_mean_return_pct": 0.2, "second_half_mean_return_pct": 0.2}
    rows = [(s, e, *(good | (change if (s, e) == ("holdout", "runup") else {})).values()) for s in ("validation", "holdout") for e in ("runup", "decline")]
    gates = pe.evidence_gates(spark.createDataFrame(rows, FOUND)).collect()
    assert len(gates) == 44 and {r.classification for r in gates if r.event_type == "decline"} == {"supported"}
    assert {r.classification for r in gates if r.event_type == "runup"} == {want} == {r.overall for r in gates}
    assert all((r.reason is None) == r.passed for r in gates)
    nothing = pe.evidence_gates(spark.createDataFrame(rows, FOUND), manifest_ok=False).first()
    assert nothing.overall == "inconclusive"


def test_pattern_gates_without_rows(spark):
    gates = pe.evidence_gates(spark.createDataFrame([], FOUND)).collect()
    assert len(gates) == 44 and {r.classification for r in gates} == {"inconclusive"} and not any(r.passed for r in gates if not r.gate.endswith("underfilled"))
