"""Market and sector context: regimes, relative strength, as-of joins and policy eligibility."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import HALO_ROWS, block_window, lay_out, owned, smooth
from ..operators.stats import exact_quantiles
from ..operators.calendar import business_days_between
from ..operators.indicators import ema_input, indicator_frame


def ema20_frame(series: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Series with ``pos``, its 20-bar exponential average, and value and average some bars earlier."""
    laid = lay_out(series.filter(F.col(value).isNotNull()), keys, "ts", HALO_ROWS, 0)
    alpha = 2.0 / 21.0
    smoothed = smooth(laid, keys, {"_e": (ema_input(F.col(value), alpha, 0), alpha)})
    w = block_window(keys)
    return owned(
        smoothed.withColumn("ema20", F.when(F.col("pos") >= 19, F.col("_e"))).withColumns(
            {"ema20_5_ago": F.lag("ema20", 5).over(w), "value_20_ago": F.lag(value, 20).over(w)}
        )
    ).drop("_e")


def regimes(proxies: DataFrame) -> DataFrame:
    """Bullish regime of every proxy bar: close > EMA20 > EMA50 and a rising EMA20 over five bars."""
    frame = indicator_frame(proxies).select("ticker", "ts", "pos", "close", "ema_20", "ema_50")
    laid = lay_out(frame.drop("pos"), ["ticker"], "ts", 5, 0)
    slope = F.col("ema_20") - F.lag("ema_20", 5).over(block_window(["ticker"]))
    out = owned(laid.withColumn("ema20_slope_5", slope))
    known = F.col("ema_50").isNotNull() & F.col("ema20_slope_5").isNotNull()
    bullish = (F.col("close") > F.col("ema_20")) & (F.col("ema_20") > F.col("ema_50")) & (F.col("ema20_slope_5") > 0)
    return out.withColumn("regime_bullish", F.when(known, bullish))


def relative_strength(bars: DataFrame, proxies: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ticker close over proxy close on common dates: ratio, its EMA20, 20-bar change, positive flag.

    ``mapping``: ticker, proxy. The proxy side is one series per proxy; Spark broadcasts it while small.
    """
    proxy = proxies.select(F.col("ticker").alias("proxy"), "ts", F.col("close").alias("proxy_close"))
    ratio = (
        bars.select("ticker", "ts", "close").join(mapping, "ticker").join(proxy, ["proxy", "ts"])
        .withColumn("rs_ratio", F.try_divide(F.col("close"), F.col("proxy_close")))
        .select("ticker", "proxy", "ts", "rs_ratio")
    )
    out = ema20_frame(ratio, ["ticker"], "rs_ratio")
    change = F.try_divide(F.col("rs_ratio"), F.col("value_20_ago")) - 1
    positive = F.when(
        (F.col("pos") >= 20) & F.col("ema20").isNotNull() & change.isNotNull(), (F.col("rs_ratio") > F.col("ema20")) & (change > 0)
    )
    return out.select("ticker", "proxy", "ts", "rs_ratio", F.col("ema20").alias("rs_ema20"), change.alias("rs_change_20_pct"), positive.alias("rs_positive"))


def as_of_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts",
    bucket_seconds: int = 86_400 * 32, best: Sequence[str] | None = None,
) -> DataFrame:
    """Each left row with one right row at or before it: columns ``asof_ts`` and ``values``.

    The last right row is taken or, with ``best``, the one highest by those columns. Both sides meet
    in time buckets per key. A bucket's opening state comes from a table of one row per (key, bucket),
    so no task sees a whole key.
    """
    keys = list(keys)
    bucket = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / bucket_seconds)
    order = F.struct(*(best or [ts]), ts)
    payload = F.struct(order.alias("_o"), F.col(ts).alias("asof_ts"), *values)
    r = right.select(*keys, F.col(ts), bucket.alias("_b"), payload.alias("_r"))
    lb = left.withColumn("_b", bucket)
    ends = r.groupBy(*keys, "_b").agg(F.max_by("_r", "_r._o").alias("_end"))
    marks = lb.select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "full")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    openings = marks.select(*keys, "_b", F.max_by("_end", "_end._o").over(before).alias("_open"))
    tagged_l = lb.select(*keys, "_b", F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    tagged_r = r.select(*keys, "_b", F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.col("_r"))
    both = tagged_l.unionByName(tagged_r, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.max_by("_r", "_r._o").over(inside)).filter("_side = 1")
    later = F.when(F.col("_open._o") > F.col("_last._o"), F.col("_open")).otherwise(F.coalesce("_last", "_open"))
    found = seen.join(openings, [*keys, "_b"], "left").withColumn("_hit", later)
    return found.select("_l.*", "_hit.asof_ts", *[F.col(f"_hit.{v}").alias(v) for v in values])


def next_on_or_after(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, name: str) -> DataFrame:
    """Each left row with the first right ``ts`` at or after its own: an as-of join on mirrored time."""
    mirrored = F.timestamp_seconds(-F.unix_seconds(F.col(ts).cast("timestamp")))
    a = left.withColumn("_mirror", mirrored)
    b = right.select(*keys, mirrored.alias("_mirror"), F.col(ts).alias(name)).distinct()
    return as_of_join(a, b, keys, [name], ts="_mirror").drop("_mirror", "asof_ts")


def context_for_signals(signals: DataFrame, market: DataFrame, strength: DataFrame, prefix: str) -> DataFrame:
    """Regime and relative strength at the last proxy bar at or before the signal, unless stale.

    ``market``: proxy regimes with column ``proxy``; ``signals`` carry ``ticker``, ``proxy`` and ``ts``.
    """
    # one proxy serves a whole universe: its state is looked up once per instant, not once per signal
    state = as_of_join(signals.select("proxy", "ts").distinct(), market, ["proxy"], ["regime_bullish"])
    joined = signals.join(state, ["proxy", "ts"], "left")
    fresh = F.coalesce(business_days_between(F.to_date("asof_ts"), F.to_date("ts")) <= 2, F.lit(False))
    joined = joined.withColumn("_fresh", fresh).withColumn(
        "regime_bullish", F.when(F.col("_fresh"), F.col("regime_bullish"))
    ).withColumnRenamed("asof_ts", "context_time")
    rs = strength.select("ticker", F.col("ts"), "rs_positive")
    at_proxy = joined.withColumn("_signal_ts", F.col("ts")).withColumn("ts", F.coalesce("context_time", F.col("ts")))
    with_rs = as_of_join(at_proxy, rs, ["ticker"], ["rs_positive"])
    out = with_rs.withColumn("ts", F.col("_signal_ts")).withColumn("rs_positive", F.when(F.col("_fresh"), F.col("rs_positive")))
    status = F.when(F.col("context_time").isNull(), "no_data").when(~F.col("_fresh"), "stale").otherwise("ok")
    return out.withColumn(f"{prefix}_status", status).withColumnsRenamed(
        {"regime_bullish": f"{prefix}_regime_bullish", "rs_positive": f"{prefix}_rs_positive", "context_time": f"{prefix}_context_time"}
    ).drop("_signal_ts", "_fresh", "asof_ts")


def eligibility(policy: str) -> tuple[Column, Column, Column]:
    """(eligible, status, reasons) of a signal row under a policy: off, market_rs or market_sector_rs."""
    none = F.array().cast("array<string>")
    if policy == "off":
        return F.lit(True), F.lit("off"), none
    needs = [("market_regime_bullish", "market regime unavailable", "market regime not bullish")]
    if policy == "market_rs":
        needs.append(("market_rs_positive", "market relative strength unavailable", "market relative strength not positive"))
    elif policy == "market_sector_rs":
        needs.append(("sector_regime_bullish", "sector regime unavailable", "sector regime not bullish"))
        needs.append(("sector_rs_positive", "sector relative strength unavailable", "sector relative strength not positive"))
    else:
        raise ValueError(f"unknown policy {policy}")
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(text)) for c, text, _ in needs])
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(text)) for c, _, text in needs]))
    ok = F.least(*[F.coalesce(F.col(c), F.lit(False)).cast("int") for c, _, _ in needs]) == 1
    status = F.when(missing.isNotNull(), "unavailable").when(ok, "eligible").otherwise("filtered")
    reasons = F.when(missing.isNotNull(), F.array(missing)).otherwise(failed)
    return ok & missing.isNull(), status, reasons


def gated_score(score: Column, eligible: Column) -> Column:
    """Score of a policy-wrapped scorer: zero when the context does not qualify."""
    return F.when(eligible, score).otherwise(0)


def close_on_or_before(decisions: DataFrame, bars: DataFrame, max_days: int = 5) -> DataFrame:
    """Close of the last bar within ``max_days`` before each decision date; days are exploded, not ranged over."""
    days = decisions.withColumn("day", F.explode(F.sequence(F.date_sub("decision_date", max_days), F.col("decision_date"))))
    b = bars.select("ticker", F.to_date("ts").alias("day"), "close")
    hit = days.join(b, ["ticker", "day"]).groupBy("ticker", "decision_date").agg(
        F.max("day").alias("close_date"), F.max_by("close", "day").alias("close")
    )
    return decisions.join(hit, ["ticker", "decision_date"], "left")


@dataclass(frozen=True)
class PolicyRule:
    """Sample minima of a policy's selection and of its holdout test."""

    minimum_validation_events: int = 100
    minimum_holdout_events: int = 100
    minimum_holdout_tickers: int = 10
    minimum_event_retention_pct: float = 25.0
    minimum_ticker_coverage_pct: float = 50.0
    positive_rate_slack_pct: float = 2.0


def policy_metrics(events: DataFrame, flags: dict[str, Column], value: str, groups: Sequence[str] = ("split",)) -> DataFrame:
    """Counts, retention, coverage and returns per policy from eligibility flags, over complete events."""
    groups = list(groups)
    rows = F.array(*[F.struct(F.lit(p).alias("policy"), F.coalesce(c, F.lit(False)).alias("kept")) for p, c in flags.items()])
    spread = events.withColumn("_p", F.explode(rows)).withColumns({"policy": F.col("_p.policy"), "_kept": F.col("_p.kept")})
    per_ticker = spread.groupBy(*groups, "policy", "ticker").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if("_kept").alias("_n"), F.sum(F.when(F.col("_kept"), F.col(value))).alias("_sum"),
        F.count(F.when(F.col("_kept"), F.col(value))).alias("_known"), F.count_if(F.col("_kept") & (F.col(value) > 0)).alias("_pos"),
    ).withColumn("_mean", F.try_divide(F.col("_sum"), F.col("_known")))
    whole = per_ticker.groupBy(*groups, "policy").agg(
        F.sum("_n").alias("eligible_events"), (F.sum("_n") / F.sum("_all") * 100).alias("event_retention_pct"),
        F.count_if(F.col("_n") > 0).alias("tickers"), (F.count_if(F.col("_n") > 0) / F.count(F.lit(1)) * 100).alias("ticker_coverage_pct"),
        F.try_divide(F.sum("_sum"), F.sum("_known")).alias("mean_net_return_pct"), (F.try_divide(F.sum("_pos"), F.sum("_known")) * 100).alias("positive_rate_pct"),
        F.avg("_mean").alias("mean_ticker_return_pct"),
    )
    cell = [*groups, "policy"]
    medians = exact_quantiles(spread.filter("_kept"), cell, value, {"median_net_return_pct": 0.5})
    ticker_medians = exact_quantiles(per_ticker, cell, "_mean", {"median_ticker_return_pct": 0.5})
    return whole.join(medians, cell, "left").join(ticker_medians, cell, "left")


JUDGED = ["eligible_events", "tickers", "event_retention_pct", "ticker_coverage_pct", "mean_net_return_pct", "mean_ticker_return_pct", "median_net_return_pct", "positive_rate_pct"]


def _beside_baseline(metrics: DataFrame, splits: Sequence[str], baseline: str) -> DataFrame:
    """One row per policy with ``<split>_<metric>`` and ``<split>_base_<metric>``; null where a split is absent."""
    own = metrics.filter(F.col("policy") != baseline).groupBy("policy").agg(*[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in splits for m in JUDGED])
    base = metrics.filter(F.col("policy") == baseline).agg(*[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_base_{m}") for s in splits for m in JUDGED])
    return own.join(base)  # the baseline is one row


def _better(split: str, rule: PolicyRule) -> dict[str, Column]:
    """What a policy must show against the baseline in a split; null figures fail."""
    x, y = (lambda m: F.col(f"{split}_{m}")), (lambda m: F.col(f"{split}_base_{m}"))
    return {
        "retention": x("event_retention_pct") >= rule.minimum_event_retention_pct, "ticker coverage": x("ticker_coverage_pct") >= rule.minimum_ticker_coverage_pct,
        "mean return": x("mean_net_return_pct") > y("mean_net_return_pct"), "mean ticker return": x("mean_ticker_return_pct") > y("mean_ticker_return_pct"),
        "median return": x("median_net_return_pct") >= y("median_net_return_pct"),
        "positive rate": x("positive_rate_pct") >= F.coalesce(y("positive_rate_pct"), F.lit(0.0)) - rule.positive_rate_slack_pct,
    }


def policy_selection(metrics: DataFrame, rule: PolicyRule, simplest: str, baseline: str = "off") -> DataFrame:
    """Every policy with ``qualifies``, its validation improvement of the mean ticker return, and ``selected`` for the best that qualifies.

    Selection sees development and validation only. Ties go to the ``simplest`` policy, then by name.
    """
    wide = _beside_baseline(metrics, ["development", "validation"], baseline)
    needs = [F.col("development_mean_net_return_pct") > F.col("development_base_mean_net_return_pct"), F.col("validation_eligible_events") >= rule.minimum_validation_events, *_better("validation", rule).values()]
    ok = F.lit(True)
    for need in needs:
        ok = ok & F.coalesce(need, F.lit(False))
    gain = F.coalesce("validation_mean_ticker_return_pct", F.lit(0.0)) - F.coalesce("validation_base_mean_ticker_return_pct", F.lit(0.0))
    out = wide.select("policy", ok.alias("qualifies"), gain.alias("validation_improvement"))
    order = Window.orderBy(F.desc("qualifies"), F.desc("validation_improvement"), F.col("policy") != simplest, "policy")  # one row per policy
    return out.withColumn("selected", F.col("qualifies") & (F.row_number().over(order) == 1))


def ticker_comparison(events: DataFrame, kept: Column, value: str) -> DataFrame:
    """Baseline and candidate events and mean returns per ticker; improved if the candidate's mean is not below."""
    k = F.coalesce(kept, F.lit(False))
    out = events.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("baseline_events"), F.count_if(k).alias("candidate_events"), F.avg(value).alias("baseline_mean_pct"), F.avg(F.when(k, F.col(value))).alias("candidate_mean_pct"))
    return out.withColumn("improved", F.coalesce(F.col("candidate_mean_pct") >= F.col("baseline_mean_pct"), F.lit(False)))


def holdout_verdict(metrics: DataFrame, tickers: DataFrame, policy: str, rule: PolicyRule, baseline: str = "off") -> DataFrame:
    """One row: whether the policy passes the holdout, and the criteria it fails (fixed order)."""
    wide = _beside_baseline(metrics.filter(F.col("policy").isin(policy, baseline)), ["holdout"], baseline)
    share = tickers.agg(F.count(F.lit(1)).alias("_represented"), F.count_if("improved").alias("_improved"))
    needs = {"events": F.col("holdout_eligible_events") >= rule.minimum_holdout_events, "tickers": F.col("holdout_tickers") >= rule.minimum_holdout_tickers, **_better("holdout", rule),
             "more than one ticker": F.col("holdout_tickers") != 1, "half of the tickers improved": (F.col("_represented") == 0) | (F.col("_improved") >= F.col("_represented") / 2)}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(need, F.lit(False)), F.lit(name)) for name, need in needs.items()]))
    return wide.join(share).select("policy", failed.alias("failures")).withColumn("passed", F.size("failures") == 0)
