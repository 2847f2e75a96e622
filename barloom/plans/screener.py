"""Latest-bar scores per timeframe, and the screener around them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFLUENCE_WEIGHTS, TIMEFRAME_BARS, IntradayWeights, LongWeights, ShortWeights
from ..operators.blocks import place_rows
from ..operators.indicators import add_indicators_to_blocks
from ..operators.ranks import add_frame_rank
from ..operators.scores import (
    SIZE, add_intraday_score, add_long_score, add_score_inputs, add_short_score, latest_bar, recent_bars,
)

MIN_BARS = 30
# The seven observation statuses.
OBSERVATION_STATUSES = [
    "signal", "below_threshold", "earnings_excluded", "earnings_failure",
    "fetch_failure", "insufficient_data", "scoring_failure",
]


def recent_indicator_frame(bars: DataFrame, rows: int) -> DataFrame:
    """Indicators over the last ``rows`` bars of each ticker: the bounded frame of a latest-bar score."""
    placed = place_rows(recent_bars(bars, ["ticker"], rows), ["ticker"], 0, 0)
    return add_score_inputs(add_indicators_to_blocks(placed, ["ticker"]), ["ticker"])


def latest_scores(
    bars: DataFrame, timeframe: str, rows: int | None = None,
    weights: IntradayWeights | ShortWeights | LongWeights | None = None,
) -> DataFrame:
    """One scored row per ticker: bars seen, score, reasons, close, volume ratio, RSI and points."""
    frame = recent_indicator_frame(bars, rows or TIMEFRAME_BARS[timeframe])
    if timeframe != "short":
        frame = add_frame_rank(frame, ["ticker"], "bb_width")
    last = latest_bar(frame).withColumnRenamed(SIZE, "bar_count").drop("own", "blk")
    if timeframe == "short":
        return add_short_score(last, weights or ShortWeights())
    if timeframe == "intraday":
        return add_intraday_score(last, weights or IntradayWeights())
    return add_long_score(last, weights or LongWeights())


def days_until(next_day: Column, today: Column) -> Column:
    return F.datediff(next_day, today)


def within_earnings_window(days: Column, limit: int) -> Column:
    """True when earnings fall within the next ``limit`` days; NULL when unknown."""
    return F.when(days.isNotNull(), (days >= 0) & (days <= limit))


def screen(
    requested: DataFrame, scores: DataFrame, timeframe: str, min_score: int,
    earnings: DataFrame | None = None, today: str | None = None, exclude_days: int = 0,
    failures: DataFrame | None = None,
) -> DataFrame:
    """One status row per requested ticker.

    ``requested``: ticker; ``scores``: :func:`latest_scores`; ``earnings``: ticker, next_earnings
    (a missing row is a failed lookup when the gate is on); ``failures``: ticker, error of the fetch.
    """
    out = requested.select("ticker").join(scores, "ticker", "left")
    gate = earnings is not None and exclude_days > 0
    if earnings is not None:
        out = out.join(earnings.select("ticker", "next_earnings"), "ticker", "left").withColumn(
            "days_until_earnings", days_until(F.col("next_earnings"), F.lit(today).cast("date"))
        )
    else:
        out = out.withColumn("days_until_earnings", F.lit(None).cast("int"))
    days = F.col("days_until_earnings")
    unknown = days.isNull() if gate else F.lit(False)
    excluded = F.coalesce(within_earnings_window(days, exclude_days), F.lit(False)) if gate else F.lit(False)
    if failures is not None:
        out = out.join(failures.select("ticker", F.col("error").alias("fetch_error")), "ticker", "left")
    else:
        out = out.withColumn("fetch_error", F.lit(None).cast("string"))
    # Observation statuses, tested in this order.
    status = (
        F.when(unknown, "earnings_failure")
        .when(excluded, "earnings_excluded")
        .when(F.col("fetch_error").isNotNull() | F.col("bar_count").isNull(), "fetch_failure")
        .when(F.col("bar_count") < MIN_BARS, "insufficient_data")
        .when(F.col("score").isNull(), "scoring_failure")
        .when(F.col("score") >= min_score, "signal")
        .otherwise("below_threshold")
    )
    scored = F.col("status").isin("signal", "below_threshold")
    return out.withColumn("status", status).select(
        "ticker",
        F.lit(timeframe).alias("timeframe"),
        "status",
        F.when(scored, F.col("score")).alias("score"),
        F.when(scored, F.bround("close", 4)).alias("last_close"),
        F.when(scored, F.bround("volume_ratio", 2)).alias("volume_ratio"),
        F.when(scored, F.bround("rsi", 1)).alias("rsi"),
        F.when(scored, F.col("reasons")).alias("reasons"),
        "days_until_earnings",
        "fetch_error",
    )


def ranked_signals(observations: DataFrame) -> DataFrame:
    """Signals by score, ticker as the tie-break."""
    return observations.filter("status = 'signal'").orderBy(F.desc("score"), "ticker")


def scan_counts(observations: DataFrame) -> DataFrame:
    """Observation counts by status and the status of the whole scan."""
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    good = count("signal", "below_threshold", "earnings_excluded")
    bad = count("earnings_failure", "fetch_failure", "insufficient_data", "scoring_failure")
    return observations.agg(
        F.count(F.lit(1)).alias("observations_n"),
        *[count(n).alias(f"{n}_n") for n in OBSERVATION_STATUSES],
        F.when((good > 0) & (bad > 0), "partial").when(good > 0, "completed").otherwise("failed").alias("session_status"),
    )


def reconcile_scan(requested: DataFrame, observations: DataFrame, results: DataFrame) -> DataFrame:
    """Checks a scan must pass, one row each with the number of offending tickers."""
    missing = requested.join(observations, "ticker", "left_anti")
    extra = observations.join(requested, "ticker", "left_anti")
    repeated = observations.groupBy("ticker").count().filter("count > 1")
    signals = observations.filter("status = 'signal'").select("ticker", "score")
    unlisted = signals.join(results, ["ticker", "score"], "left_anti")
    unbacked = results.join(signals, ["ticker", "score"], "left_anti")
    out = None
    for name, frame in [
        ("requested_without_row", missing), ("row_without_request", extra), ("ticker_repeated", repeated),
        ("signal_not_in_results", unlisted), ("result_without_signal", unbacked),
    ]:
        row = frame.agg(F.count(F.lit(1)).alias("offending")).select(F.lit(name).alias("check"), "offending")
        out = row if out is None else out.unionByName(row)
    return out


def confluence(scores: dict[str, DataFrame], earnings: DataFrame | None = None, exclude_days: int = 0, today: str | None = None) -> DataFrame:
    """Weighted score over the three timeframes; a missing timeframe counts zero."""
    long_form = None
    for tf in CONFLUENCE_WEIGHTS:
        part = scores[tf].filter(F.col("bar_count") >= MIN_BARS).select(
            "ticker", F.lit(tf).alias("timeframe"), "score", "close"
        )
        long_form = part if long_form is None else long_form.unionByName(part)
    wide = long_form.groupBy("ticker").agg(
        *[F.max(F.when(F.col("timeframe") == tf, F.col("score"))).alias(f"score_{tf}") for tf in CONFLUENCE_WEIGHTS],
        *[F.max(F.when(F.col("timeframe") == tf, F.col("close"))).alias(f"_close_{tf}") for tf in CONFLUENCE_WEIGHTS],
    )
    return confluence_of(wide, earnings, exclude_days, today)


def confluence_of(wide: DataFrame, earnings: DataFrame | None = None, exclude_days: int = 0, today: str | None = None) -> DataFrame:
    """Confluence columns of a row per ticker with ``score_<timeframe>`` and ``_close_<timeframe>``."""
    tfs = list(CONFLUENCE_WEIGHTS)
    score = {tf: F.col(f"score_{tf}") for tf in tfs}
    total = sum((F.coalesce(score[tf], F.lit(0)) * F.lit(w) for tf, w in CONFLUENCE_WEIGHTS.items()), F.lit(0.0))
    n_available = sum((score[tf].isNotNull().cast("int") for tf in tfs), F.lit(0))
    n_active = sum((F.coalesce(score[tf] >= 50, F.lit(False)).cast("int") for tf in tfs), F.lit(0))
    c = F.col("confluence_score")
    # Tier names, tested in this order.
    tier = (
        F.when(n_available == 0, "no data")
        .when((n_available == 3) & (n_active == 3) & (c >= 90), "all timeframes aligned")
        .when((n_active >= 2) & (c >= 70), "strong confluence")
        .when((n_active >= 2) & (c >= 50), "moderate confluence")
        .when(n_available == 1, "weak / single timeframe")
        .when(n_available == 2, "weak / incomplete timeframes")
        .otherwise("weak confluence")
    )
    out = (
        wide.withColumn("confluence_score", F.least(F.greatest(F.bround(total, 0), F.lit(0.0)), F.lit(100.0)).cast("int"))
        .withColumn("tier", tier)
        .withColumn("timeframe_coverage", F.concat(n_available.cast("string"), F.lit("/3")))
        .withColumn("active_timeframes", F.array_compact(F.array(*[F.when(score[tf] >= 50, tf) for tf in tfs])))
        .withColumn("available_timeframes", F.array_compact(F.array(*[F.when(score[tf].isNotNull(), tf) for tf in tfs])))
        .withColumn("missing_timeframes", F.array_compact(F.array(*[F.when(score[tf].isNull(), tf) for tf in tfs])))
        .withColumn("last_close", F.coalesce(*[F.col(f"_close_{tf}") for tf in tfs]))
    )
    if earnings is not None and exclude_days > 0:
        out = out.join(earnings.select("ticker", "next_earnings"), "ticker", "left").withColumn(
            "days_until_earnings", days_until(F.col("next_earnings"), F.lit(today).cast("date"))
        )
        out = out.filter(~F.coalesce(within_earnings_window(F.col("days_until_earnings"), exclude_days), F.lit(False)))
    return out.drop(*[f"_close_{tf}" for tf in tfs])
