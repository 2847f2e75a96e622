"""Event study and backtest under a market-context policy."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BacktestConfig, Split
from ..operators.blocks import number_rows
from ..operators.stats import exact_quantiles
from ..session import settle
from .backtest import run_backtest
from .context import context_for_signals, eligibility, gated_score


def with_market_context(signals: DataFrame, regimes: DataFrame, strength: DataFrame, policy: str = "market_rs") -> DataFrame:
    """Signals (ticker, ts, ...) with the market's state at their time and the policy's verdict."""
    tagged = signals.withColumn("proxy", F.lit("MARKET"))
    market = regimes.select(F.col("ticker").alias("proxy"), "ts", "regime_bullish")
    joined = context_for_signals(tagged, market, strength, "market").drop("proxy")
    ok, status, reasons = eligibility(policy)
    return joined.withColumns({"context_eligible": ok, "context_status": status, "context_reasons": reasons})


def gated_scores(scored: DataFrame, context: DataFrame) -> DataFrame:
    """Scored bars whose score is zero where the context does not qualify."""
    flags = context.select("ticker", "ts", "context_eligible")
    joined = scored.join(flags, ["ticker", "ts"], "left")
    return joined.withColumn("score", gated_score(F.col("score"), F.coalesce("context_eligible", F.lit(False))).cast("int")).drop("context_eligible")


def holdout_bars(bars: DataFrame, holdout: Split, warmup: int) -> DataFrame:
    """Bars of the holdout window with the ``warmup`` bars up to and including its first one; nothing earlier can move the result.

    Tickers without a holdout bar, or without enough bars before it, have none.
    """
    day = F.to_date("ts")
    numbered = settle(number_rows(bars, ["ticker"]))
    span = numbered.filter(day.between(F.lit(holdout.start), F.lit(holdout.end))).groupBy("ticker").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    return numbered.join(span.filter(F.col("_first") + 1 >= warmup), "ticker").filter(F.col("pos").between(F.col("_first") - (warmup - 1), F.col("_last"))).drop("pos", "_first", "_last")


KEPT = ["total_trades", "expectancy_pct", "total_return_pct", "profit_factor", "max_drawdown_pct", "sharpe_ratio"]


def paired_backtests(scored: DataFrame, gated: DataFrame, config: BacktestConfig) -> DataFrame:
    """Baseline and candidate metrics side by side per ticker; both frames are scored bars of the holdout window."""
    side = lambda m, p: settle(m.select("ticker", *[F.col(c).alias(f"{p}_{c}") for c in KEPT]))
    base, cand = (run_backtest(None, config, scored=x)["metrics"] for x in (scored, gated))
    return side(base, "baseline").join(side(cand, "candidate"), "ticker", "full")


# Texts of the executable gate's failures.
FAILURES = {
    "none": "no overlapping tickers between baseline and candidate", "zero": "candidate trade count is zero", "one": "improvement produced by only one ticker",
    "median": "median candidate expectancy not greater than baseline", "mean": "mean candidate expectancy not greater than baseline",
    "return": "median candidate total return lower than baseline", "drawdown": "candidate max drawdown worse by more than 2 percentage points",
}


def executable_gate(paired: DataFrame, tolerance_pct: float = 2.0) -> DataFrame:
    """One row: whether the candidate passes, the reasons if not, and the medians compared.

    Tickers that both sides hold and the candidate traded are compared, all with one weight. A figure without a value (no trades of the
    baseline) counts in no median or mean; a comparison without figures fails nothing.
    """
    both = paired.filter(F.col("baseline_total_trades").isNotNull() & F.col("candidate_total_trades").isNotNull())
    some = settle(both.withColumn("_study", F.lit(1)).withColumn("_eligible", F.col("candidate_total_trades") > 0))
    eligible = some.filter("_eligible")
    out = some.groupBy("_study").agg(F.count(F.lit(1)).alias("compared_tickers"), F.count_if("_eligible").alias("eligible_tickers"))
    means = eligible.groupBy("_study").agg(*[F.avg(f"{p}_expectancy_pct").alias(f"{p}_mean_expectancy_pct") for p in ("baseline", "candidate")])
    out = paired.sparkSession.range(1).select(F.lit(1).alias("_study")).join(out, "_study", "left").join(means, "_study", "left")
    for c in ("expectancy_pct", "total_return_pct", "max_drawdown_pct"):
        for p in ("baseline", "candidate"):
            out = out.join(exact_quantiles(eligible, ["_study"], f"{p}_{c}", {f"{p}_median_{c}": 0.5}), "_study", "left")
    fails = lambda name, c: F.when(c, FAILURES[name])
    compared = F.array_compact(F.array(
        fails("one", F.col("eligible_tickers") == 1), fails("median", F.col("candidate_median_expectancy_pct") <= F.col("baseline_median_expectancy_pct")),
        fails("mean", F.col("candidate_mean_expectancy_pct") <= F.col("baseline_mean_expectancy_pct")), fails("return", F.col("candidate_median_total_return_pct") < F.col("baseline_median_total_return_pct")),
        fails("drawdown", F.col("candidate_median_max_drawdown_pct") < F.col("baseline_median_max_drawdown_pct") - tolerance_pct),
    ))
    reasons = (
        F.when(F.coalesce("compared_tickers", F.lit(0)) == 0, F.array(F.lit(FAILURES["none"]))).when(F.col("eligible_tickers") == 0, F.array(F.lit(FAILURES["zero"]))).otherwise(compared)
    )
    return out.drop("_study").withColumn("failure_reasons", reasons).withColumn("passed", F.size("failure_reasons") == 0)
