"""The session study as a whole: eligibility, the signals of three strategies, metrics by stratum, month and gap, gates and the verdict."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import number_rows, running_peak, running_total
from ..operators.stats import exact_quantiles
from ..session import settle
from .intraday import SESSION, SessionSpec, attempt_trades, reclaim_signals, score_signals

# The strategies, security types that never trade, rejections with their reasons, exits.
STRATEGIES = ["candidate", "baseline_a", "baseline_b"]
EXCLUDED_TYPES = ["otc", "warrant", "right", "unit", "preferred_stock"]
REJECTIONS = {
    "rejected_no_next_bar": "next_expected_bar_missing_or_invalid",
    "rejected_entry_at_or_below_stop": "next_bar_open_at_or_below_stop",
    "rejected_nonpositive_risk": "nonpositive_or_nonfinite_risk_per_share",
}
EXITS = ("gap_stop", "gap_target", "stop", "target", "time", "time_fallback")
CELL = ["strategy", "scenario", "grouping", "member"]


@dataclass(frozen=True)
class SampleMinimums:
    """Sample sizes below which the study is inconclusive, and limits of the gates."""

    trades: int = 300
    stock_symbols: int = 25
    etf_symbols: int = 8
    stock_trades: int = 100
    etf_trades: int = 75
    overlap: int = 15
    max_pct_of_trades: float = 10.0
    max_pct_of_profit: float = 20.0
    profit_factor: float = 1.05
    positive_symbols: float = 0.55
    outperformance: float = 0.55
    drawdown_tolerance_pct: float = 2.0
    lift_vs_a: float = 0.05
    lift_vs_b: float = 0.03


def eligibility(meta: DataFrame, spec: SessionSpec) -> DataFrame:
    """``meta`` with ``reasons`` why a ticker does not trade, and ``eligible``; what is not known (null) is no reason.

    ``meta`` has ticker, is_eligible, prior_close, median_dollar_volume, security_type and is_etf, as known before the session.
    """
    reasons = F.array_compact(F.array(
        F.when(~F.col("is_eligible"), "ticker_not_eligible"),
        F.when(F.col("prior_close") < spec.prior_close_min, "prior_close_below_min"),
        F.when(F.col("median_dollar_volume") < spec.prior_dollar_volume_min, "prior_20_median_dollar_volume_below_threshold"),
        F.when(F.lower("security_type").isin(EXCLUDED_TYPES), F.concat(F.lit("security_type_excluded_"), F.col("security_type"))),
    ))
    return meta.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def gap_bucket(gap: Column) -> Column:
    """Bucket of an opening gap given as a fraction of the prior close."""
    return (
        F.when(gap.isNull(), "unknown").when(gap < -0.01, "below_minus_1pct").when(gap < 0, "minus_1pct_to_0")
        .when(gap == 0, "zero").when(gap <= 0.01, "0_to_plus_1pct").otherwise("above_plus_1pct")
    )


def session_signals(bars: DataFrame, drives: DataFrame, grid: DataFrame, meta: DataFrame, costs: Sequence[tuple[str, float]], spec: SessionSpec) -> DataFrame:
    """One row per ticker, session, strategy and cost scenario: a trade, a rejection or no signal, with its reason.

    Eligibility comes first: bars of other tickers are never searched, their sessions state why. ``bars`` and ``drives`` are written tables.
    """
    known = F.broadcast(eligibility(meta, spec).select("ticker", "eligible", F.array_join("reasons", ";").alias("why_not"), "is_etf", "prior_close"))  # one row a ticker
    trading = settle(bars.join(known.filter("eligible").select("ticker"), "ticker", "left_semi"))
    signals = settle(
        reclaim_signals(trading, drives, spec, "candidate", True).unionByName(reclaim_signals(trading, drives, spec, "baseline_b", False))
        .unionByName(score_signals(trading, spec))
    )
    trades = attempt_trades(signals, trading, grid, costs, spec)
    done = number_rows(
        bars.filter("valid").groupBy(*SESSION).agg(F.count(F.lit(1)).cast("double").alias("_valid")), ["ticker"], "session_date")
    history = running_total(done, ["ticker"], {"_history": F.col("_valid")}).select(*SESSION, "_history")
    scenarios = F.explode(F.array(*[F.lit(n) for n, _ in costs])).alias("scenario")
    sessions = bars.groupBy(*SESSION).agg(F.max(F.when((F.col("grid_idx") == 0), F.col("open"))).alias("_first_open")).join(history, SESSION, "left")
    each = sessions.select("*", F.explode(F.array(*[F.lit(s) for s in STRATEGIES])).alias("strategy")).select("*", scenarios)
    drive = drives.select(*SESSION, F.col("qualified").alias("_drive"))
    nothing = (
        F.when(~F.col("eligible"), F.col("why_not")).when(F.col("strategy") != "baseline_a", "no_reclaim_bar_found")
        .when(F.coalesce("_history", F.lit(0.0)) < 20, "insufficient_history_for_indicators").otherwise("no_score_reached_40")
    )
    rejected = F.create_map(*[F.lit(x) for pair in REJECTIONS.items() for x in pair])
    gap = (F.col("_first_open") - F.col("prior_close")) / F.when(F.col("prior_close") != 0, F.col("prior_close"))
    status = F.coalesce("status", F.lit("no_signal"))
    executed = F.col("status") == "executed"
    return (
        each.join(trades, [*SESSION, "strategy", "scenario"], "left").join(drive, SESSION, "left").join(known, "ticker")
        .withColumns({
            "reason": F.when(F.col("status").isNull(), nothing).otherwise(rejected[F.col("status")]),
            "opening_drive_qualified": F.when((F.col("strategy") == "candidate") & F.col("eligible"), F.coalesce("_drive", F.lit(False))),
        })
        .withColumns({
            "opening_gap": F.when(executed, gap), "month": F.when(executed, F.date_format("session_date", "yyyy-MM")).otherwise("unknown"),
        })
        .withColumns({"status": status, "gap_bucket": gap_bucket(F.col("opening_gap"))})
        .drop("_first_open", "_history", "_drive", "eligible", "why_not", "prior_close")
    )


def grouped(signals: DataFrame, primary: str) -> DataFrame:
    """Every signal in its groups: all, and for the primary scenario also its month and its opening gap's bucket."""
    own = F.array(
        F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("member")),
        F.when(F.col("scenario") == primary, F.struct(F.lit("month").alias("grouping"), F.col("month").alias("member"))),
        F.when(F.col("scenario") == primary, F.struct(F.lit("gap").alias("grouping"), F.col("gap_bucket").alias("member"))),
    )
    return signals.select("*", F.inline(F.array_compact(own)))


def signal_counts(signals: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Signals by what became of them: rejections by kind, exits by kind, rate of gains, holding time."""
    x = F.col("status") == "executed"
    return signals.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_signals"), F.count_if(x).alias("executed_trades"), F.count_if(F.col("status").startswith("rejected")).alias("rejected_signals"),
        F.count_if(F.col("status") == "no_signal").alias("no_signal_count"),
        *[F.count_if(F.col("status") == s).alias(s) for s in REJECTIONS], *[F.count_if(F.col("exit_type") == t).alias(f"exit_{t}") for t in EXITS],
        F.avg(F.when(x, F.coalesce(F.col("net_r") > 0, F.lit(False)).cast("double"))).alias("positive_trade_rate"), F.avg(F.when(x, F.col("holding_minutes"))).alias("average_holding_minutes"),
    )


def _drawdown(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Lowest fall below the peak of 100 plus cumulative R, trades in time order."""
    done = trades.filter(F.col("net_r").isNotNull()).withColumn("ts", F.col("session_date").cast("timestamp"))
    ordered = number_rows(done.select(*keys, "ts", "signal_idx", *[c for c in ["ticker"] if c not in keys], "net_r"), keys, "ts", ties=["signal_idx", "ticker"])
    summed = running_total(ordered, keys, {"_cum": F.col("net_r")}).withColumn("equity", 100.0 + F.col("_cum"))
    peaked = running_peak(summed, keys, {"_peak": F.col("equity")}).withColumn("_peak", F.greatest(F.col("_peak"), F.lit(100.0)))
    return peaked.groupBy(*keys).agg(F.min(F.least(F.lit(0.0), 100.0 * (F.col("equity") - F.col("_peak")) / F.col("_peak"))).alias("maximum_drawdown_pct"))


def finite_trades(signals: DataFrame) -> DataFrame:
    """Executed trades, a result that is no finite number as null."""
    r = F.col("net_r")
    return signals.filter("status = 'executed'").withColumn("net_r", F.when(~F.isnan(r) & (F.abs(r) < float("inf")), r))


def per_symbol_metrics(trades: DataFrame, groups: Sequence[str]) -> DataFrame:
    """R metrics per symbol of ``finite_trades``: totals, profit-factor case and order (unbounded sorts above all), drawdown."""
    keys = [*groups, "ticker"]
    r = F.col("net_r")
    m = trades.groupBy(*keys).agg(
        F.first("is_etf").alias("is_etf"), F.count(F.lit(1)).alias("_executed"), F.count(r).alias("trade_count"), F.coalesce(F.sum(r), F.lit(0.0)).alias("total_return"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("gross_profit"), F.sum(F.when(r < 0, r).otherwise(0.0)).alias("gross_loss"),
    )
    up, down = F.col("gross_profit"), F.col("gross_loss")
    # Profit-factor cases.
    case = (
        F.when(F.col("trade_count") == 0, "no_trade").when((up == 0) & (down == 0), "break_even").when((up == 0) & (down < 0), "no_profit")
        .when((up > 0) & (down == 0), "no_loss_positive").otherwise("finite")
    )
    value = F.when(F.col("profit_factor_case") == "finite", up / F.abs(down)).when(F.col("profit_factor_case").isin("break_even", "no_profit"), 0.0)
    return (
        m.join(_drawdown(trades, keys), keys, "left")
        .withColumn("maximum_drawdown_pct", F.coalesce("maximum_drawdown_pct", F.lit(0.0)))
        .withColumn("mean_expectancy", F.when(F.col("trade_count") > 0, F.col("total_return") / F.col("trade_count")).otherwise(0.0))
        .withColumn("profit_factor_case", case).withColumn("profit_factor_value", value)
        .withColumn("profit_factor_order", F.when(F.col("profit_factor_case") == "no_loss_positive", float("inf")).otherwise(F.col("profit_factor_value")))
        .withColumn("positive", F.col("mean_expectancy") > 0)
    )


def study_metrics(signals: DataFrame, symbols: DataFrame, trades: DataFrame, groups: Sequence[str] = CELL) -> DataFrame:
    """One row per group: counts, pooled results, medians over symbols, strata and concentrations.

    ``symbols`` and ``trades`` are written tables of the same groups. The profit factor's median ranks unbounded ones above all; it is null
    unless at least half of the represented symbols have one, and its value is null where it is unbounded. A group without trades has zero
    expectancies and null medians.
    """
    groups = list(groups)
    shown = symbols.filter("trade_count > 0")
    total, r, etf = F.col("total_return"), F.col("net_r"), F.col("is_etf")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    pooled = trades.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_trades"), zero(F.sum(r)).alias("pooled_total_return"),
        *[x for name, side in (("stock", ~etf), ("etf", etf)) for x in (
            F.count_if(side).alias(f"{name}_stratum_trade_count"), zero(F.try_divide(F.sum(F.when(side, r)), F.count_if(side))).alias(f"{name}_stratum_pooled_expectancy"))],
    )
    loss = F.when(total < 0, -total)
    across = shown.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("represented_symbols"), F.count_if(~etf).alias("represented_stock_symbols"), F.count_if(etf).alias("represented_etf_symbols"),
        F.avg("mean_expectancy").alias("equal_weighted_per_symbol_mean_expectancy"), F.avg(F.col("positive").cast("double")).alias("positive_symbol_rate"),
        F.max("trade_count").alias("_most"), F.max(F.when(total > 0, total)).alias("_best"), F.max(loss).alias("_worst"), F.sum(loss).alias("_losses"),
        F.count("profit_factor_order").alias("_ordered"),
    )
    out = signal_counts(signals, groups).join(pooled, groups, "left").join(across, groups, "left")
    out = out.join(_drawdown(trades, groups).withColumnRenamed("maximum_drawdown_pct", "overall_maximum_drawdown_pct"), groups, "left")
    for column, name in (("mean_expectancy", "expectancy"), ("total_return", "total_return"), ("maximum_drawdown_pct", "maximum_drawdown_pct"), ("profit_factor_order", "profit_factor_order")):
        out = out.join(exact_quantiles(shown, groups, column, {f"median_per_symbol_{name}": 0.5}), groups, "left")
    order = F.col("median_per_symbol_profit_factor_order")
    none = F.lit(0).cast("bigint")
    counts = ["total_trades", "stock_stratum_trade_count", "etf_stratum_trade_count", "represented_symbols", "represented_stock_symbols", "represented_etf_symbols"]
    out = out.withColumns({c: F.coalesce(F.col(c), none) for c in counts})
    out = out.withColumns({c: zero(F.col(c)) for c in ("pooled_total_return", "stock_stratum_pooled_expectancy", "etf_stratum_pooled_expectancy", "overall_maximum_drawdown_pct")})
    gained = F.col("pooled_total_return") > 0
    return out.withColumns({
        "pooled_expectancy": zero(F.try_divide("pooled_total_return", "total_trades")),
        "trade_count_concentration": zero(F.try_divide("_most", "total_trades")),
        "net_profit_concentration": F.when(gained, F.col("_best") / F.col("pooled_total_return")),
        "absolute_loss_concentration": F.when(~gained, F.try_divide("_worst", "_losses")),
        "median_per_symbol_profit_factor_order": F.when((F.col("represented_symbols") > 0) & (F.col("_ordered") >= F.ceil(F.col("represented_symbols") / 2)), order),
    }).withColumn("median_per_symbol_profit_factor_value", F.when(F.col("median_per_symbol_profit_factor_order") < float("inf"), F.col("median_per_symbol_profit_factor_order"))
                  ).drop("_most", "_best", "_worst", "_losses", "_ordered")


def paired_outperformance(symbols: DataFrame, candidate: str, baseline: str, groups: Sequence[str] = ("scenario",)) -> DataFrame:
    """Symbols traded by both strategies and how often the candidate's expectancy is higher."""
    side = lambda s, n: symbols.filter((F.col("strategy") == s) & (F.col("trade_count") > 0)).select(*groups, "ticker", F.col("mean_expectancy").alias(n))
    return side(candidate, "a").join(side(baseline, "b"), [*groups, "ticker"]).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("overlap"), F.avg((F.col("a") > F.col("b")).cast("double")).alias("outperformance_rate")
    )


def session_features(signals: DataFrame) -> DataFrame:
    """One row per ticker and session with the three strategies side by side; ``signals`` of one scenario."""
    wide = signals.groupBy(*SESSION).pivot("strategy", STRATEGIES).agg(
        F.first("status").alias("status"), F.first("reason").alias("reason"), F.first("opening_drive_qualified").alias("opening_drive_qualified"), F.first("score").alias("score"))
    return wide.select(
        *SESSION, F.coalesce("candidate_status", F.lit("no_signal")).alias("candidate_status"), "candidate_reason", "candidate_opening_drive_qualified",
        F.coalesce("baseline_a_status", F.lit("no_signal")).alias("baseline_a_status"), "baseline_a_score", F.coalesce("baseline_b_status", F.lit("no_signal")).alias("baseline_b_status"))


def ticker_comparison(symbols: DataFrame) -> DataFrame:
    """One row per ticker that the candidate trades, with both baselines' figures; ``symbols`` of one scenario."""
    wide = symbols.groupBy("ticker").pivot("strategy", STRATEGIES).agg(*[
        F.first(c).alias(c) for c in ("is_etf", "trade_count", "total_return", "mean_expectancy", "maximum_drawdown_pct")])
    mean = F.col("candidate_mean_expectancy")
    return wide.filter(F.col("candidate_trade_count").isNotNull()).select(
        "ticker", F.col("candidate_is_etf").alias("is_etf"), "candidate_trade_count", "candidate_total_return", "candidate_mean_expectancy", "candidate_maximum_drawdown_pct",
        *[f"{b}_{c}" for b in STRATEGIES[1:] for c in ("trade_count", "mean_expectancy")],
        *[(mean > F.col(f"{b}_mean_expectancy")).alias(f"candidate_beat_{b[-1]}") for b in STRATEGIES[1:]])


def data_reasons(quality: DataFrame, contract: Column, sufficiency: Column) -> DataFrame:
    """One row: the contract's violations (``ticker:reason``), and shortfalls of sufficiency with the number of tables that have them."""
    broken = quality.select(F.explode(F.transform(contract, lambda x: F.concat(F.col("ticker"), F.lit(":"), x))).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("contract_reasons"))
    short = quality.select(F.explode(sufficiency).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    told = F.concat("x", F.lit(" ("), "n", F.lit(" symbol-month"), F.when(F.col("n") != 1, "s").otherwise(""), F.lit(")"))
    return broken.crossJoin(short.agg(F.array_sort(F.collect_list(told)).alias("sufficiency_reasons")))


def evaluate_gates(metrics: DataFrame, paired: DataFrame, data: DataFrame, primary: str, dear: str, minimums: SampleMinimums = SampleMinimums()) -> DataFrame:
    """The twelve gates (gate, passed, reason) with the study's disposition and its reason.

    ``metrics`` are those of the group ``all``; ``paired`` compares the candidate with the first baseline in the primary scenario; ``data`` is the
    row of ``data_reasons``. A gate that cannot be computed is null. A broken data contract makes the study invalid and leaves the first gate alone.
    """
    of = lambda strategy, scenario, name: metrics.filter((F.col("strategy") == strategy) & (F.col("scenario") == scenario)).select(F.struct("*").alias(name))
    spark = metrics.sparkSession
    row = spark.range(1).crossJoin(of("candidate", primary, "c")).crossJoin(of("baseline_a", primary, "a")).crossJoin(of("baseline_b", primary, "b")).crossJoin(of("candidate", dear, "d"))
    pairs = paired.filter(F.col("scenario") == primary).select("overlap", "outperformance_rate", F.lit(1).alias("_one"))
    row = row.withColumn("_one", F.lit(1)).join(pairs, "_one", "left").crossJoin(data).withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    m = minimums
    c = lambda x: F.col(f"c.{x}")
    below = lambda name, label, least: F.when(c(name) < least, F.format_string(f"{label}_%d_below_{least}", c(name)))
    over = lambda name, most: F.when(c(name) * 100 > most, F.format_string(f"{name}_%.2f%%_exceeds_{most}%%", c(name) * 100))
    sample = F.array_compact(F.array(
        below("total_trades", "executed_candidate_trades", m.trades), below("represented_stock_symbols", "represented_stock_symbols", m.stock_symbols),
        below("represented_etf_symbols", "represented_etfs", m.etf_symbols), below("stock_stratum_trade_count", "stock_stratum_trades", m.stock_trades),
        below("etf_stratum_trade_count", "etf_stratum_trades", m.etf_trades), over("trade_count_concentration", m.max_pct_of_trades),
        over("net_profit_concentration", m.max_pct_of_profit), over("absolute_loss_concentration", m.max_pct_of_profit),
    ))
    short = F.size("sufficiency_reasons") > 0
    reasons = F.concat(sample, F.when(short, F.concat(F.array(F.lit("data_sufficiency_failed")), F.col("sufficiency_reasons"))).otherwise(F.array().cast("array<string>")))
    row = row.withColumn("sample_reasons", reasons)
    sample_met = F.size("sample_reasons") == 0
    joined = F.array_join("sample_reasons", "; ")
    pf = "median_per_symbol_profit_factor_order"
    shown = lambda x: F.coalesce(F.when(x == float("inf"), "inf").otherwise(F.format_string("%.4f", x)), F.lit("none"))
    within = lambda x, most: x.isNull() | (x * 100 <= most)
    expectancy = "median_per_symbol_expectancy"
    drawdown = "median_per_symbol_maximum_drawdown_pct"

    def against(side: str, lift: float):
        a, b = c(expectancy), F.col(f"{side}.{expectancy}")
        name = f"baseline_{side}"
        return F.when(a.isNotNull() & b.isNotNull(), a >= b + lift), F.coalesce(F.format_string(f"candidate=%.4f_{name}=%.4f_lift_required={lift}", F.when(b.isNotNull(), a), b), F.lit(None))

    def told(passed: Column, text: Column, missing: str) -> Column:
        return F.when(passed.isNull(), missing).otherwise(text)

    lift_a, lift_b = against("a", m.lift_vs_a), against("b", m.lift_vs_b)
    at_least = F.when(c(pf).isNotNull(), c(pf) >= m.profit_factor)
    not_below = F.when(c(pf).isNotNull() & F.col(f"a.{pf}").isNotNull() & F.col(f"b.{pf}").isNotNull(), (c(pf) >= F.col(f"a.{pf}")) & (c(pf) >= F.col(f"b.{pf}")))
    rate = F.when(c("positive_symbol_rate").isNotNull(), c("positive_symbol_rate") >= m.positive_symbols)
    outperforms = F.when(F.col("overlap") >= m.overlap, F.coalesce("outperformance_rate", F.lit(0.0)) >= m.outperformance)
    pair_text = F.when(F.col("overlap") < m.overlap, F.format_string(f"paired_overlap_%d_below_{m.overlap}", "overlap")).otherwise(
        F.format_string("paired_overlap=%d_outperform_rate=%.4f", "overlap", F.coalesce("outperformance_rate", F.lit(0.0))))
    base = F.col(f"a.{drawdown}")
    drawn = F.when(c(drawdown).isNotNull() & base.isNotNull(), c(drawdown) >= base - m.drawdown_tolerance_pct)
    stock, etf = c("stock_stratum_pooled_expectancy"), c("etf_stratum_pooled_expectancy")
    limits = (c("trade_count_concentration") * 100 <= m.max_pct_of_trades) & within(c("net_profit_concentration"), m.max_pct_of_profit) & within(c("absolute_loss_concentration"), m.max_pct_of_profit)
    dear_r = F.col("d.pooled_expectancy")
    # Gate names and reason texts.
    gates = [
        ("1_sample_and_data_sufficiency", sample_met, F.when(sample_met, "ok").otherwise(joined)),
        ("2_candidate_pooled_expectancy_positive_5bps", c("pooled_expectancy") > 0, F.format_string("pooled_expectancy=%.4f", c("pooled_expectancy"))),
        ("3_candidate_median_expectancy_vs_baseline_a", lift_a[0], told(*lift_a, "median_per_symbol_expectancy_not_computable")),
        ("4_candidate_median_expectancy_vs_baseline_b", lift_b[0], told(*lift_b, "median_per_symbol_expectancy_not_computable")),
        ("5_candidate_median_profit_factor_threshold", at_least, told(at_least, F.concat(F.lit("median_pf_order="), shown(c(pf))), "profit_factor_median_not_computable")),
        ("6_candidate_median_profit_factor_not_below_baselines", not_below, told(
            not_below, F.concat(F.lit("candidate="), shown(c(pf)), F.lit("_vs_a="), shown(F.col(f"a.{pf}")), F.lit("_vs_b="), shown(F.col(f"b.{pf}"))), "profit_factor_median_not_comparable")),
        ("7_positive_symbol_rate", rate, told(rate, F.format_string("positive_symbol_rate=%.4f", c("positive_symbol_rate")), "positive_symbol_rate_not_computable")),
        ("8_paired_symbol_outperformance_vs_baseline_a", outperforms, pair_text),
        ("9_median_drawdown_not_worse_than_baseline", drawn, told(
            drawn, F.format_string(f"candidate_mdd=%.4f_baseline_mdd=%.4f_tolerance={m.drawdown_tolerance_pct}", c(drawdown), base), "median_mdd_not_computable")),
        ("10_stock_and_etf_strata_nonneg_expectancy", (stock >= 0) & (etf >= 0), F.format_string("stock=%.4f_etf=%.4f", stock, etf)),
        ("11_candidate_pooled_expectancy_nonneg_10bps", dear_r >= 0, F.format_string("pooled_expectancy_10bps=%.4f", dear_r)),
        ("12_concentration_limits", limits, F.lit("concentration_within_limits")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), p.alias("passed"), t.alias("reason")) for n, p, t in gates])
    invalid = F.size("contract_reasons") > 0
    row = row.select("sample_reasons", "contract_reasons", F.when(invalid, F.slice(rows, 1, 1)).otherwise(rows).alias("gates"))
    passed = F.transform("gates", lambda g: g["passed"])
    failed = F.transform(F.filter("gates", lambda g: ~g["passed"]), lambda g: g["gate"])
    disposition = (
        F.when(invalid, "invalid").when(~sample_met, "inconclusive").when(F.exists(passed, lambda p: p.isNull()), "inconclusive")
        .when(F.forall(passed, lambda p: p), "supported").otherwise("not_supported")
    )
    why = (
        F.when(invalid, F.array_join("contract_reasons", "; "))
        .when(~sample_met, F.concat(F.lit("sample_or_data_sufficiency_minimums_not_met: "), joined))
        .when(F.exists(passed, lambda p: p.isNull()), "required_gate_not_computable").when(F.size(failed) == 0, "all_gates_passed")
        .otherwise(F.concat(F.lit("gates_failed: "), F.array_join(failed, ", ")))
    )
    return row.select(F.inline("gates"), disposition.alias("disposition"), why.alias("disposition_reason"))
