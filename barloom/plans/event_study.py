"""Point-in-time event study of the short score and its aggregate tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EventStudyConfig, Split
from ..functions.returns import bucket_label, net_return_pct
from ..operators.blocks import BLOCK_ROWS, block_window, owned
from ..operators.calendar import in_split
from ..operators.indicators import with_indicators
from ..operators.scores import SHORT_COMPONENTS, add_short_score
from ..operators.stats import METRICS, exact_quantiles, group_metrics, on_scaffold


def score_events(bars: DataFrame, config: EventStudyConfig, splits: Sequence[Split], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per scored bar after the warm-up: score, components, next open, and the bar h ahead per horizon."""
    reach = max(config.horizons) + 1
    scored = add_short_score(with_indicators(bars, ("ticker",), reach, block_rows))
    w = block_window(["ticker"])
    ahead = {"entry_time": F.lead("ts", 1).over(w), "raw_entry_price": F.lead("open", 1).over(w)}
    for h in config.horizons:
        ahead[f"exit_time_{h}"] = F.lead("ts", h).over(w)
        ahead[f"exit_price_{h}"] = F.lead("close", h).over(w)
    events = owned(scored.withColumns(ahead)).filter(F.col("pos") >= config.warmup_bars)
    events = events.withColumn("split", in_split(F.to_date("ts"), splits)).filter(F.col("split").isNotNull())
    # a price of a later split is never shown
    same = in_split(F.to_date("entry_time"), splits) == F.col("split")
    enters = F.coalesce(same, F.lit(False))
    events = events.withColumn("enters", enters)
    horizon_rows = []
    for h in config.horizons:
        inside = F.coalesce(in_split(F.to_date(f"exit_time_{h}"), splits) == F.col("split"), F.lit(False))
        done = F.col("enters") & inside & F.col(f"exit_price_{h}").isNotNull()
        horizon_rows.append(
            F.struct(
                F.lit(h).alias("horizon"),
                F.when(done, F.col(f"exit_time_{h}")).alias("exit_time"),
                F.when(done, F.col(f"exit_price_{h}")).alias("raw_exit_price"),
                F.when(done, "complete").otherwise("insufficient_future_bars").alias("outcome_status"),
            )
        )
    return events.select(
        "ticker", "split", F.col("ts").alias("signal_time"), "score", *SHORT_COMPONENTS, "reasons",
        F.col("close").alias("signal_close"),
        F.when(F.col("enters"), F.col("entry_time")).alias("entry_time"),
        F.when(F.col("enters"), F.col("raw_entry_price")).alias("raw_entry_price"),
        F.array(*horizon_rows).alias("outcomes"),
    )


def event_outcomes(events: DataFrame, config: EventStudyConfig) -> DataFrame:
    """Long form: one row per event, horizon and cost scenario."""
    costs = F.array(*[F.lit(float(s)) for s in config.slippage_bps])
    o = F.col("o")
    return (
        events.withColumn("o", F.explode("outcomes"))
        .withColumn("slippage_bps", F.explode(costs))
        .select(
            *[c for c in events.columns if c != "outcomes"],
            o["horizon"].alias("horizon_bars"), o["exit_time"].alias("exit_time"),
            o["raw_exit_price"].alias("raw_exit_price"), o["outcome_status"].alias("outcome_status"),
            "slippage_bps",
        )
        .withColumn("gross_return_pct", (F.col("raw_exit_price") / F.col("raw_entry_price") - 1.0) * 100.0)
        .withColumn(
            "net_return_pct",
            net_return_pct(F.col("raw_entry_price"), F.col("raw_exit_price"), F.col("slippage_bps"), config.commission_bps),
        )
    )


def _complete(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("outcome_status = 'complete'")


def _scaffold(outcomes: DataFrame, config: EventStudyConfig, name: str, values: list) -> DataFrame:
    """Splits seen in the data x horizons x cost scenarios x configured values."""
    return (
        outcomes.select("split").distinct()
        .withColumn("horizon_bars", F.explode(F.array(*[F.lit(h) for h in config.horizons])))
        .withColumn("slippage_bps", F.explode(F.array(*[F.lit(float(s)) for s in config.slippage_bps])))
        .withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    )


CELL = ["split", "horizon_bars", "slippage_bps"]


def score_buckets(outcomes: DataFrame, config: EventStudyConfig) -> DataFrame:
    groups = [*CELL, "score_bucket"]
    rows = _complete(outcomes).withColumn("score_bucket", bucket_label(F.col("score"), config.bucket_edges))
    metrics = group_metrics(rows, groups, "net_return_pct", config.minimum_group_events)
    return on_scaffold(_scaffold(outcomes, config, "score_bucket", config.bucket_labels()), metrics, groups)


def thresholds(outcomes: DataFrame, config: EventStudyConfig) -> DataFrame:
    """Events at and above every threshold, with retention and ticker coverage."""
    groups = [*CELL, "threshold"]
    complete = _complete(outcomes)
    levels = F.array(*[F.lit(t) for t in config.thresholds])
    rows = complete.withColumn("threshold", F.explode(F.filter(levels, lambda t: t <= F.col("score"))))
    metrics = group_metrics(rows, groups, "net_return_pct", config.minimum_group_events)
    totals = (
        complete.groupBy(*CELL, "ticker").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*CELL).agg(F.sum("_n").alias("_events"), F.count(F.lit(1)).alias("_tickers"))
    )
    full = on_scaffold(_scaffold(outcomes, config, "threshold", list(config.thresholds)), metrics, groups)
    label = F.when(F.col("threshold") == 40, "current_default").otherwise(F.concat(F.lit("threshold_"), F.col("threshold")))
    return (
        full.join(totals, CELL, "left")
        .withColumn("threshold_label", label)
        .withColumn("event_retention_pct", F.coalesce(F.col("event_count") / F.col("_events") * 100.0, F.lit(0.0)))
        .withColumn("ticker_coverage_pct", F.coalesce(F.col("unique_tickers") / F.col("_tickers") * 100.0, F.lit(0.0)))
        .drop("_events", "_tickers")
    )


def _flag_rows(df: DataFrame) -> DataFrame:
    flags = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("present")) for c in SHORT_COMPONENTS])
    return df.withColumn("f", F.explode(flags)).withColumns({"component": F.col("f.component"), "present": F.col("f.present")}).drop("f")


def components(outcomes: DataFrame, config: EventStudyConfig) -> DataFrame:
    """Metrics with a component present and absent, and present minus absent."""
    groups = [*CELL, "component", "component_state"]
    state = F.when(F.col("present"), "present").otherwise("absent")
    rows = _flag_rows(_complete(outcomes)).withColumn("component_state", state)
    metrics = group_metrics(rows, groups, "net_return_pct", config.minimum_group_events)
    scaffold = _scaffold(outcomes, config, "component", SHORT_COMPONENTS).withColumn(
        "component_state", F.explode(F.array(F.lit("present"), F.lit("absent")))
    )
    full = on_scaffold(scaffold, metrics, groups)
    at = lambda c, s: F.max(F.when(F.col("component_state") == s, F.col(c)))
    pairs = {"mean_net_return_pct": "mean_return", "median_net_return_pct": "median_return", "positive_return_rate_pct": "positive_rate"}
    deltas = full.groupBy(*CELL, "component").agg(
        *[(at(c, "present") - at(c, "absent")).alias(f"{n}_present_minus_absent") for c, n in pairs.items()]
    )
    return full.join(deltas, [*CELL, "component"])


def score_distribution(events: DataFrame) -> DataFrame:
    """Exact-score counts and their share of the split."""
    per = events.groupBy("split", "score", "ticker").agg(F.count(F.lit(1)).alias("_n"))
    scores = per.groupBy("split", F.col("score").alias("exact_score")).agg(
        F.sum("_n").alias("event_count"), F.count(F.lit(1)).alias("unique_tickers")
    )
    totals = scores.groupBy("split").agg(F.sum("event_count").alias("_all"))
    return scores.join(totals, "split").withColumn("percentage_of_split_events", F.col("event_count") / F.col("_all") * 100.0).drop("_all")


def component_frequency(events: DataFrame) -> DataFrame:
    return _flag_rows(events.select("split", *SHORT_COMPONENTS)).groupBy("split", "component").agg(
        F.count_if("present").alias("present_count"),
        (F.count_if("present") / F.count(F.lit(1)) * 100.0).alias("present_pct"),
    )


def ticker_summary(outcomes: DataFrame) -> DataFrame:
    groups = ["split", "ticker", "horizon_bars", "slippage_bps"]
    rows = _complete(outcomes)
    v = F.col("net_return_pct")
    moments = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("event_count"), F.avg(v).alias("mean_net_return_pct"),
        (F.count_if(v > 0) / F.count(v) * 100.0).alias("positive_return_rate_pct"),
    )
    return moments.join(exact_quantiles(rows, groups, "net_return_pct", {"median_net_return_pct": 0.5}), groups)


def study_quality(events: DataFrame, config: EventStudyConfig, splits: Sequence[Split]) -> DataFrame:
    """Per ticker: events per split and complete outcomes per horizon."""
    done = lambda i: F.col("outcomes")[i]["outcome_status"] == "complete"
    return events.groupBy("ticker").agg(
        *[F.count_if(F.col("split") == s.name).alias(f"{s.name}_events") for s in splits],
        *[F.count_if(done(i)).alias(f"complete_{h}_bar_outcomes") for i, h in enumerate(config.horizons)],
    )
