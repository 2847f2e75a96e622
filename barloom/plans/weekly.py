"""Weekly study: scored candidate rule against a 40-week average, outcomes, trades and tables."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Split
from ..functions.returns import bucket_label, net_return_pct, slippage_key
from ..operators.blocks import block_window, number_rows, owned, running_peak, running_total
from ..operators.calendar import in_split
from ..operators.greedy import choose_non_overlapping
from ..operators.indicators import with_indicators
from ..operators.ranks import expanding_rank
from ..operators.scores import add_long_score, add_score_inputs
from ..operators.stats import cluster_bootstrap, exact_quantiles
from ..session import settle


@dataclass(frozen=True)
class WeeklySpec:
    hold_weeks: tuple[int, ...] = (13, 26)
    threshold: int = 40
    sma_weeks: int = 40
    min_bars: int = 60
    slippage_bps: tuple[float, ...] = (0.0, 10.0, 25.0)
    commission_bps: float = 0.0
    bucket_edges: tuple[int, ...] = (0, 25, 40, 60, 80, 101)
    bootstrap_seed: int = 20260805
    bootstrap_resamples: int = 5_000
    # Costs of the decision, sample minima and limits of the verdict.
    decision_bps: float = 5.0
    sensitivity_bps: float = 25.0
    minimum_ticker_trades: int = 5
    minimum_signals: int = 200
    minimum_stock_tickers: int = 20
    minimum_etf_tickers: int = 8
    minimum_lift_bps: float = 50.0
    support_q10_bps: float = 100.0
    reject_q10_bps: float = 200.0
    reject_lift_bps: float = 50.0
    leading_share: float = 0.6


def weekly_signals(weekly: DataFrame, spec: WeeklySpec, splits: Sequence[Split]) -> DataFrame:
    """Every evaluated week with both rules' flags and the entry and exit weeks ahead."""
    w = block_window(["ticker"])
    laid = add_score_inputs(with_indicators(weekly, ("ticker",), max(spec.hold_weeks) + 1), ["ticker"])
    sma = F.when(F.col("pos") >= spec.sma_weeks - 1, F.avg("close").over(w.rowsBetween(-(spec.sma_weeks - 1), 0)))
    ahead = {"sma": sma, "entry_open": F.lead("open", 1).over(w), "entry_at": F.lead("first_session_open_time", 1).over(w), "entry_week": F.lead("ts", 1).over(w)}
    for h in spec.hold_weeks:
        ahead[f"exit_close_{h}"] = F.lead("close", h + 1).over(w)
        ahead[f"exit_week_{h}"] = F.lead("ts", h + 1).over(w)
    rows = add_long_score(expanding_rank(settle(owned(laid.withColumns(ahead))), ["ticker"], "bb_width")).filter(F.col("pos") >= spec.min_bars - 1)
    rows = rows.withColumn("split", in_split(F.to_date("ts"), splits)).filter(F.col("split").isNotNull())
    candidate = F.coalesce(F.col("score") >= spec.threshold, F.lit(False))
    baseline = F.coalesce(F.col("close") > F.col("sma"), F.lit(False))
    return rows.withColumns({"candidate": candidate, "baseline": baseline})


def weekly_events(signals: DataFrame, market: DataFrame, spec: WeeklySpec, splits: Sequence[Split]) -> DataFrame:
    """One row per firing rule, week and holding period, with status, returns and the benchmark's return."""
    both = F.col("candidate") & F.col("baseline")
    rules = F.array_compact(F.array(F.when(F.col("candidate"), F.lit("candidate")), F.when(F.col("baseline"), F.lit("baseline"))))
    holds = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"exit_close_{h}").alias("exit_close"), F.col(f"exit_week_{h}").alias("exit_week")) for h in spec.hold_weeks
    ])
    out = (
        signals.withColumn("rule", F.explode(rules)).withColumn("h", F.explode(holds))
        .withColumn("overlap_group", F.when(both, "baseline_and_candidate").otherwise(F.concat(F.col("rule"), F.lit("_only"))))
        .select("ticker", "pos", "split", F.col("ts").alias("signal_time"), "rule", "overlap_group",
                F.when(F.col("rule") == "candidate", F.col("score")).alias("score"), "entry_open", "entry_at", "entry_week", "h.horizon", "h.exit_close", "h.exit_week")
    )
    same = lambda t: F.coalesce(in_split(F.to_date(t), splits) == F.col("split"), F.lit(False))
    status = (
        F.when(F.col("entry_open").isNull(), "insufficient_future_bars").when(~same("entry_at"), "cross_split_excluded")
        .when(F.col("exit_close").isNull(), "insufficient_future_bars").when(~same("exit_week"), "cross_split_excluded").otherwise("complete")
    )
    m = market.select("ts", "open", "close")  # one benchmark series
    opens = m.select(F.col("ts").alias("entry_week"), F.col("open").alias("market_open"))
    closes = m.select(F.col("ts").alias("exit_week"), F.col("close").alias("market_close"))
    out = out.withColumn("outcome_status", status).join(opens, "entry_week", "left").join(closes, "exit_week", "left")
    done = F.col("outcome_status") == "complete"
    nets = {
        f"net_return_pct_{slippage_key(s)}bps": F.when(done, net_return_pct(F.col("entry_open"), F.col("exit_close"), s, spec.commission_bps)) for s in spec.slippage_bps
    }
    return out.withColumns(
        {
            "gross_return_pct": F.when(done, (F.col("exit_close") / F.col("entry_open") - 1) * 100),
            "market_return_pct": F.when(done & (F.col("market_open") > 0), (F.col("market_close") / F.col("market_open") - 1) * 100), **nets,
        }
    )


def weekly_trades(events: DataFrame, spec: WeeklySpec) -> DataFrame:
    """Non-overlapping trades per ticker and rule by the first holding period.

    An excluded trade does not hold the next one back; one without enough future ends the walk.
    """
    h = spec.hold_weeks[0]
    keys = ["ticker", "rule"]
    free = F.col("pos") + F.when(F.col("outcome_status") == "cross_split_excluded", 1).otherwise(h + 2)
    primary = events.filter(F.col("horizon") == h).select(*keys, "pos", free.alias("free_at"))
    chosen = choose_non_overlapping(primary, keys, "pos", "free_at", max(4_096, h + 2))
    return events.join(chosen, [*keys, "pos"])


def summary_tables(rows: DataFrame, value: str, spec: WeeklySpec) -> DataFrame:
    """Counts, mean and win rate by (rule, split, horizon) and by overlap group, score bucket and ticker in one pass."""
    r = rows.filter(F.col(value).isNotNull()).withColumn("score_bucket", F.when(F.col("score").isNotNull(), bucket_label(F.col("score"), spec.bucket_edges)))
    base = ["rule", "split", "horizon"]
    extra = ["overlap_group", "score_bucket", "ticker"]
    sets = [base, *[[*base, c] for c in extra]]
    named = F.when(F.col("_id") == 7, "total")
    for bit, c in zip((4, 2, 1), extra):
        named = named.when(F.col("_id") == 7 - bit, c)
    return (
        r.groupingSets(sets, *base, *extra)
        .agg(F.grouping_id(*base, *extra).alias("_id"), F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean_return_pct"),
             F.stddev_pop(value).alias("std_return_pct"), (F.count_if(F.col(value) > 0) / F.count(F.lit(1)) * 100).alias("win_rate_pct"))
        .withColumn("table", named).withColumn("member", F.coalesce(*extra)).drop("_id", *extra)
    )


def downside(rows: DataFrame, value: str) -> DataFrame:
    """Quantiles and the drawdown of cumulative returns taken ticker by ticker in time order.

    Each ticker is reduced to (total, highest, lowest, worst drop); the fold over tickers is exact
    because the drop against an earlier peak is the lowest prefix minus that peak.
    """
    cell = ["rule", "split", "horizon"]
    keys = [*cell, "ticker"]
    r = rows.filter(F.col(value).isNotNull()).withColumn("ts", F.col("signal_time"))
    numbered = number_rows(r.drop("pos"), keys, "ts")
    summed = running_total(numbered, keys, {"_cum": F.col(value)})
    peaked = running_peak(summed, keys, {"_peak": F.col("_cum")})
    parts = peaked.groupBy(*keys).agg(
        F.max_by("_cum", "pos").alias("total"), F.max("_cum").alias("high"), F.min("_cum").alias("low"), F.min(F.col("_cum") - F.col("_peak")).alias("drop")
    )
    minus = F.lit(float("-inf"))
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct("ticker", "total", "high", "low", "drop"))),
        F.struct(F.lit(0.0).alias("cum"), minus.alias("peak"), F.lit(0.0).alias("worst")),
        lambda a, x: F.struct(
            (a["cum"] + x["total"]).alias("cum"), F.greatest(a["peak"], a["cum"] + x["high"]).alias("peak"),
            F.least(a["worst"], x["drop"], F.when(a["peak"] > minus, a["cum"] + x["low"] - a["peak"]).otherwise(0.0)).alias("worst"),
        ),
        lambda a: a["worst"],
    )
    drops = parts.groupBy(*cell).agg(folded.alias("max_drawdown_pct"))
    qs = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    counts = r.groupBy(*cell).agg(F.count(F.lit(1)).alias("count"))
    return counts.join(exact_quantiles(r, cell, value, qs), cell).join(drops, cell)


def cost_sensitivity(rows: DataFrame, spec: WeeklySpec) -> DataFrame:
    costs = F.array(*[F.struct(F.lit(float(s)).alias("slippage_bps"), F.col(f"net_return_pct_{slippage_key(s)}bps").alias("net")) for s in spec.slippage_bps])
    long_form = rows.withColumn("c", F.explode(costs)).select("rule", "split", "horizon", "c.slippage_bps", "c.net").filter("net IS NOT NULL")
    cell = ["rule", "split", "horizon", "slippage_bps"]
    m = long_form.groupBy(*cell).agg(F.count(F.lit(1)).alias("count"), F.avg("net").alias("mean_net_return_pct"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"))
    return m.join(exact_quantiles(long_form, cell, "net", {"median_net_return_pct": 0.5}), cell)


def exposure(trades: DataFrame, spec: WeeklySpec) -> DataFrame:
    h = spec.hold_weeks[0]
    done = F.count_if(F.col("outcome_status") == "complete")
    return trades.filter(F.col("horizon") == h).groupBy("ticker", "rule", "split").agg(
        F.count(F.lit(1)).alias("trade_count"), done.alias("complete_count"), (done * h).alias("weeks_in_market")
    )


def paired_clusters(rows: DataFrame, value: str) -> DataFrame:
    """(ticker, year) clusters that hold both rules: mean of each and their difference."""
    per = rows.filter(F.col(value).isNotNull()).groupBy("split", "horizon", "ticker", F.year("signal_time").alias("year")).agg(
        F.avg(F.when(F.col("rule") == "candidate", F.col(value))).alias("candidate"), F.avg(F.when(F.col("rule") == "baseline", F.col(value))).alias("baseline")
    )
    return per.dropna(subset=["candidate", "baseline"]).withColumn("difference", F.col("candidate") - F.col("baseline"))


def paired_bootstrap(rows: DataFrame, value: str, spec: WeeklySpec) -> DataFrame:
    clusters = paired_clusters(rows, value).withColumn("cluster", F.concat_ws(":", "ticker", "year")).withColumn("one", F.lit(1))
    return cluster_bootstrap(clusters, ["split", "horizon"], "difference", "one", spec.bootstrap_resamples, spec.bootstrap_seed)


def ordered_mean(c: Column) -> Column:
    """A mean that depends on the values alone and not on the order in which they come, so that two rules with the same trades tie.

    For one ticker's weeks in a split, which the calendar bounds.
    """
    values = F.array_sort(F.collect_list(c))
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def rule_lift(rows: DataFrame, value: str, min_trades: int = 5) -> DataFrame:
    """Per split and horizon: pooled lift of the candidate and the share of tickers where it leads."""
    per = rows.filter(F.col(value).isNotNull()).groupBy("split", "horizon", "ticker").agg(
        *[f(F.when(F.col("rule") == r, F.col(value))).alias(f"{r}_{n}") for r in ("candidate", "baseline") for n, f in (("n", F.count), ("mean", ordered_mean), ("sum", F.sum))]
    )
    enough = (F.col("candidate_n") >= min_trades) & (F.col("baseline_n") >= min_trades)
    return per.groupBy("split", "horizon").agg(
        (F.sum("candidate_sum") / F.sum("candidate_n") - F.sum("baseline_sum") / F.sum("baseline_n")).alias("pooled_lift_pct"),
        F.count_if(enough).alias("compared_tickers"),
        F.avg(F.when(enough, (F.col("candidate_mean") > F.col("baseline_mean")).cast("double"))).alias("positive_fraction"),
    )


def split_evidence(trades: DataFrame, spec: WeeklySpec) -> DataFrame:
    """Per split, over complete trades of the first holding period with their ``cohort``: counts, lifts and shares of leading tickers.

    Lifts are the candidate's mean less the baseline's, net at the decision cost and at the sensitivity cost; the q10 lift compares the
    tenth percentiles. A ticker counts for a cohort's share only with enough trades of both rules; figures without a sample are null.
    """
    net, dear = f"net_return_pct_{slippage_key(spec.decision_bps)}bps", f"net_return_pct_{slippage_key(spec.sensitivity_bps)}bps"
    rows = trades.filter((F.col("horizon") == spec.hold_weeks[0]) & (F.col("outcome_status") == "complete"))
    of = lambda rule, c: F.when(F.col("rule") == rule, F.col(c))
    per = rows.groupBy("split", "ticker", "cohort").agg(*[
        f(of(rule, c)).alias(f"{rule}_{name}") for rule in ("candidate", "baseline")
        for name, f, c in (("n", F.count, net), ("sum", F.sum, net), ("mean", ordered_mean, net), ("dear_n", F.count, dear), ("dear_sum", F.sum, dear))
    ])
    enough = (F.col("candidate_n") >= spec.minimum_ticker_trades) & (F.col("baseline_n") >= spec.minimum_ticker_trades)
    leads = (F.col("candidate_mean") > F.col("baseline_mean")).cast("double")
    mean = lambda rule, kind="": F.try_divide(F.sum(f"{rule}_{kind}sum"), F.sum(f"{rule}_{kind}n"))
    out = per.groupBy("split").agg(
        F.sum("candidate_n").alias("candidate_count"), F.sum("baseline_n").alias("baseline_count"), (mean("candidate") - mean("baseline")).alias("lift_pct"),
        (mean("candidate", "dear_") - mean("baseline", "dear_")).alias("sensitivity_lift_pct"),
        *[F.count_if((F.col(f"{rule}_n") > 0) & (F.col("cohort") == c)).alias(f"{rule}_{c}_tickers") for rule in ("candidate", "baseline") for c in ("stock", "etf")],
        *[F.avg(F.when(enough & (F.col("cohort") == c), leads)).alias(f"leading_{c}_share") for c in ("stock", "etf")],
    )
    tails = exact_quantiles(rows, ["split", "rule"], net, {"q10": 0.1}).groupBy("split").agg(F.max(of("candidate", "q10")).alias("c"), F.max(of("baseline", "q10")).alias("b"))
    return out.join(tails.select("split", (F.col("c") - F.col("b")).alias("q10_lift_pct")), "split", "left")


def conclusion(evidence: DataFrame, bootstrap: DataFrame, spec: WeeklySpec) -> DataFrame:
    """One row with the study's verdict from the holdout's evidence, its interval and the validation's direction.

    Reasons to reject come first, then the sample minima, then everything support needs; a figure that is missing supports nothing.
    """
    hold = evidence.filter("split = 'holdout'").drop("split").withColumn("_one", F.lit(1))
    interval = bootstrap.filter((F.col("split") == "holdout") & (F.col("horizon") == spec.hold_weeks[0])).select("ci_low", "ci_high", F.lit(1).alias("_one"))
    check = evidence.filter("split = 'validation'").select(F.col("lift_pct").alias("validation_lift_pct"), F.lit(1).alias("_one"))
    one = evidence.sparkSession.range(1).select(F.lit(1).alias("_one"))
    j = one.join(hold, "_one", "left").join(interval, "_one", "left").join(check, "_one", "left").drop("_one")
    lift, q10 = F.col("lift_pct"), F.col("q10_lift_pct")
    yes = lambda c: F.coalesce(c, F.lit(False))
    reject = (
        yes(F.col("ci_high") <= 0) | yes(lift <= -spec.reject_lift_bps / 100)
        | (yes(q10 < -spec.reject_q10_bps / 100) & F.coalesce(lift <= 0, F.lit(True)))
    )
    sampled = (F.col("candidate_count") >= spec.minimum_signals) & (F.col("baseline_count") >= spec.minimum_signals)
    for rule in ("candidate", "baseline"):
        sampled = sampled & (F.col(f"{rule}_stock_tickers") >= spec.minimum_stock_tickers) & (F.col(f"{rule}_etf_tickers") >= spec.minimum_etf_tickers)
    support = (
        sampled & (lift >= spec.minimum_lift_bps / 100) & (F.col("ci_low") > 0) & (q10 >= -spec.support_q10_bps / 100) & (F.col("sensitivity_lift_pct") > 0)
        & (F.col("leading_stock_share") >= spec.leading_share) & (F.col("leading_etf_share") >= spec.leading_share) & (F.col("validation_lift_pct") > 0)
    )
    verdict = F.when(reject, "reject_or_deprioritize").when(yes(support), "supports_further_research").otherwise("inconclusive")
    return j.withColumn("conclusion", verdict)
