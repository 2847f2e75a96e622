"""Scan history: daily scores, coils, fades, ticker states, outcomes, journal and statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import OUTCOME_SESSIONS
from ..functions.numbers import half_even

COIL_SCORE = 45.0
MIN_SESSIONS = 2
BREAKOUT_PCT = 3.0


def daily_scores(observations: DataFrame, sessions: DataFrame, timeframe: str, since: str) -> DataFrame:
    """Latest scored observation per ticker and trading date (ties by observation id), combined map-side."""
    runs = sessions.filter(
        (F.col("timeframe") == timeframe) & (F.col("scan_time") >= F.lit(since).cast("timestamp")) & F.col("trading_date").isNotNull()
    ).select("session_id", "scan_time", "trading_date")
    scored = observations.filter(F.col("status").isin("signal", "below_threshold")).join(runs, "session_id")
    row = F.struct("scan_time", "id", "score", "last_close", "status")
    return (
        scored.groupBy("ticker", "trading_date").agg(F.max(row).alias("r"))
        .select("ticker", "trading_date", "r.scan_time", "r.score", "r.last_close", "r.status")
    )


def _setup_facts(points: DataFrame, breakout_pct: float = BREAKOUT_PCT) -> DataFrame:
    """One row of facts per ticker; the series is bounded by the number of trading dates looked back."""
    order = Window.partitionBy("ticker").orderBy("trading_date")
    p = points.withColumn("i", (F.row_number().over(order) - 1).cast("double")).withColumn("s", F.col("score").cast("double"))
    facts = p.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("appearances"),
        F.count_if(F.col("s") >= COIL_SCORE).alias("active_sessions"),
        F.max_by("s", "trading_date").alias("latest_score"), F.max("s").alias("peak_score"),
        F.max_by("status", "trading_date").alias("latest_status"),
        F.min_by("last_close", "trading_date").alias("first_close"), F.max_by("last_close", "trading_date").alias("last_close"),
        F.min_by("scan_time", "trading_date").alias("first_seen"), F.max_by("scan_time", "trading_date").alias("last_seen"),
        F.regr_slope("s", "i").alias("_slope"),
        F.transform(F.array_sort(F.collect_list(F.struct("trading_date", "score"))), lambda x: x["score"]).alias("score_history"),
    )
    trend = F.when(F.col("appearances") >= 2, half_even(F.col("_slope"), 2)).otherwise(0.0)
    moved = F.abs(F.try_divide(F.col("last_close") - F.col("first_close"), F.col("first_close"))) * 100
    broke = F.when((F.col("appearances") < 2) | (F.col("first_close") == 0), False).otherwise(moved >= breakout_pct)
    return facts.withColumn("score_trend", trend).withColumn("broke_out", broke).drop("_slope")


def coil_strength() -> Column:
    n, t = F.col("appearances"), F.col("score_trend")
    persistence = F.least(n / 5, F.lit(1.0)) * 20
    frequency = F.col("active_sessions") / n * 20
    trend = F.greatest(F.least(t * 10, F.lit(20.0)), F.lit(0.0))
    return half_even(F.least(F.lit(100.0), F.col("latest_score") * 0.4 + persistence + frequency + trend), 1)


def fade_strength() -> Column:
    zero = F.lit(0.0)
    drop = F.greatest(zero, F.col("peak_score") - F.col("latest_score")) * 2
    below = F.greatest(zero, COIL_SCORE - F.col("latest_score")) * 1.5
    trend = F.greatest(zero, -F.col("score_trend")) * 20
    return half_even(F.least(F.lit(100.0), drop + below + trend), 1)


def detect_coils(points: DataFrame, min_appearances: int = MIN_SESSIONS, breakout_pct: float = BREAKOUT_PCT) -> DataFrame:
    """Tickers with a persistent, not fading score that have not moved yet, strongest first."""
    t = F.col("score_trend")
    kept = _setup_facts(points, breakout_pct).filter(
        (F.col("appearances") >= min_appearances) & (F.col("latest_score") >= COIL_SCORE) & ~F.col("broke_out") & (t >= -0.5)
    )
    return kept.withColumns(
        {
            "coil_strength": coil_strength(),
            "trend_direction": F.when(t > 0.5, "building").when(t > -0.5, "stable").otherwise("fading"),
            "last_close": half_even(F.col("last_close"), 2),
        }
    ).drop("broke_out", "first_close").orderBy(F.desc("coil_strength"), "ticker")


def _is_fading() -> Column:
    latest, peak = F.col("latest_score"), F.col("peak_score")
    return (peak >= COIL_SCORE) & ((latest < COIL_SCORE) | ((F.col("score_trend") < -0.5) & (latest < peak)))


def detect_fading(points: DataFrame, min_appearances: int = MIN_SESSIONS) -> DataFrame:
    t = F.col("score_trend")
    kept = _setup_facts(points).filter((F.col("appearances") >= min_appearances) & _is_fading())
    return kept.withColumns(
        {
            "fade_strength": fade_strength(),
            "trend_direction": F.when(t < -0.5, "fading").when(t < 0.5, "stable").otherwise("building"),
            "last_close": half_even(F.col("last_close"), 2),
        }
    ).drop("broke_out", "first_close").orderBy(F.desc("fade_strength"), "ticker")


# The states a watched ticker can be in.
STATES = {
    "building": "coiling — building pressure", "stable": "coiling — stable", "fading": "fading",
    "watching": "watching", "none": "no history",
}


def ticker_states(watchlist: DataFrame, points: DataFrame) -> DataFrame:
    """State and summary of every watched ticker, also of those never seen."""
    f = watchlist.select("ticker").join(_setup_facts(points), "ticker", "left")
    active = (F.col("appearances") >= MIN_SESSIONS) & (F.col("latest_score") >= COIL_SCORE) & ~F.col("broke_out")
    status = (
        F.when(F.col("appearances").isNull(), STATES["none"])
        .when(active & (F.col("score_trend") > 0.5), STATES["building"])
        .when(active, STATES["stable"]).when(_is_fading(), STATES["fading"]).otherwise(STATES["watching"])
    )
    out = f.withColumn("status", status).withColumn(
        "days_building",
        F.floor((F.unix_seconds("last_seen") - F.unix_seconds("first_seen")) / 86_400),
    )
    # Summary texts per state.
    summary = (
        F.when(F.col("status") == STATES["none"], "Not seen in recent scans.")
        .when(F.col("status") == STATES["building"], F.concat(
            F.col("ticker"), F.lit(" has appeared "), F.col("appearances"), F.lit("x over "), F.col("days_building"),
            F.lit(" days with a score trending up (slope: +"), F.col("score_trend"),
            F.lit("). No breakout yet. Setup is strengthening — watch closely.")))
        .when(F.col("status") == STATES["stable"], F.concat(
            F.col("ticker"), F.lit(" has appeared "), F.col("appearances"), F.lit("x over "), F.col("days_building"),
            F.lit(" days with a steady score ("), F.col("latest_score"), F.lit("). Potential setup holding, not yet accelerating.")))
        .when(F.col("status") == STATES["fading"], F.concat(F.col("ticker"), F.lit(" was signaling but score is declining. Setup may be breaking down.")))
        .otherwise(F.concat(F.col("ticker"), F.lit(" has appeared "), F.col("appearances"), F.lit("x but hasn't met coil criteria yet.")))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.withColumn("summary", summary).select(
        "ticker", "status", zero("appearances"), zero("days_building"), zero("latest_score"), zero("peak_score"), zero("score_trend"), "summary"
    ).orderBy(F.desc("latest_score"), "ticker")


# ---- outcomes -----------------------------------------------------------------------------------

def resolve_outcomes(signals: DataFrame, daily: DataFrame, as_of: str, windows: dict[str, int] = OUTCOME_SESSIONS) -> DataFrame:
    """Outcome close of each signal: the Nth later session's close, or the next known one in the window.

    A signal reaches at most N + 7 days ahead, so it is exploded to those days and joined on
    (ticker, day): equal work per key and no range join.
    """
    n = F.lit(3)
    for tf, k in windows.items():
        n = F.when(F.col("timeframe") == tf, k).otherwise(n)
    s = signals.withColumn("n", n).withColumn("day0", F.to_date("scan_time"))
    last = F.least(F.date_add("day0", F.col("n") + 7), F.lit(as_of).cast("date"))
    first = F.date_add("day0", 1)
    reach = s.filter(last >= first).withColumn("day", F.explode(F.sequence(first, last)))
    bars = daily.select("ticker", F.to_date("ts").alias("day"), F.col("close").alias("later"))
    seen = (
        reach.join(bars, ["ticker", "day"])
        .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("day", "later"))).alias("rows"))  # at most n + 7
    )
    out = s.join(seen, "id", "left")
    tail = F.filter(F.slice("rows", F.col("n"), F.greatest(F.size("rows") - F.col("n") + 1, F.lit(0))), lambda x: x["later"].isNotNull())
    close = F.when(F.size("rows") >= F.col("n"), F.get(tail, F.lit(0))["later"])
    return out.withColumn("outcome_close", half_even(close, 4)).withColumns(
        {
            "outcome_pct": half_even((close - F.col("last_close")) / F.col("last_close") * 100, 2),
            "outcome_status": F.when(F.col("outcome_close").isNotNull(), "resolved").otherwise("pending"),
        }
    ).drop("rows", "n", "day0")


def with_outcomes(signals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Signals with their written-back outcome (outcomes are an append table, never a row update)."""
    latest = outcomes.groupBy("id").agg(F.max(F.struct("marked_at", "outcome_close", "outcome_pct", "outcome_provider")).alias("o"))
    return signals.join(latest.select("id", "o.outcome_close", "o.outcome_pct", "o.outcome_provider"), "id", "left")


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "80-100").when(score >= 60, "60-79").when(score >= 40, "40-59").otherwise("<40")


def outcome_stats(resolved: DataFrame) -> DataFrame:
    """Total, mean, win rate, best and worst per timeframe and score band, unrounded: a figure is rounded once, where it is shown."""
    x = F.col("outcome_pct")
    return resolved.filter(F.col("outcome_close").isNotNull()).groupBy("timeframe", score_band(F.col("score")).alias("score_bucket")).agg(
        F.count(F.lit(1)).alias("total"), F.avg(x).alias("avg_return_pct"),
        (F.avg((x > 0).cast("int")) * 100).alias("win_rate_pct"), F.max(x).alias("best"), F.min(x).alias("worst"),
    )


def journal(resolved: DataFrame, timeframe: str | None = None, min_score: int = 0) -> DataFrame:
    rows = resolved.filter(F.col("outcome_close").isNotNull() & (F.col("score") >= min_score))
    if timeframe:
        rows = rows.filter(F.col("timeframe") == timeframe)
    return rows.withColumns(
        {"signal_provider": F.coalesce("provider", F.lit("unknown")), "outcome_provider": F.coalesce("outcome_provider", F.lit("unknown"))}
    )


def journal_kpis(rows: DataFrame) -> DataFrame:
    """Win rate, mean win and loss, expectancy and the number of provider mismatches."""
    x = F.col("outcome_pct")
    known = (F.col("signal_provider") != "unknown") & (F.col("outcome_provider") != "unknown")
    k = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(x > 0).alias("wins"), F.count_if(x <= 0).alias("losses"),
        F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(x <= 0, x)), F.lit(0.0)).alias("avg_loss"),
        F.count_if(known & (F.col("signal_provider") != F.col("outcome_provider"))).alias("provider_mismatches"),
    )
    return k.withColumn("win_rate_pct", F.try_divide(F.col("wins"), F.col("total")) * 100).withColumn(
        "expectancy", F.try_divide(F.col("wins"), F.col("total")) * F.col("avg_win") + F.try_divide(F.col("losses"), F.col("total")) * F.col("avg_loss")
    )


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum."""
    bounds = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    idx = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    return rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def recent_appearances(signals: DataFrame, timeframe: str, since: str) -> DataFrame:
    kept = signals.filter((F.col("timeframe") == timeframe) & (F.col("scan_time") >= F.lit(since).cast("timestamp")))
    return kept.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("appearances"), F.max("score").alias("peak_score"), F.avg("score").alias("avg_score"),
        F.max("scan_time").alias("last_seen"), F.min("scan_time").alias("first_seen"),
    ).orderBy(F.desc("appearances"), F.desc("peak_score"), "ticker")


def recent_runs(runs: DataFrame, limit: int, timeframe: str | None = None) -> DataFrame:
    """Newest scan runs with their hit rate."""
    rows = runs if timeframe is None else runs.filter(F.col("timeframe") == timeframe)
    rate = F.when(F.col("counts_complete") & (F.coalesce("tickers_n", F.lit(0)) > 0), 100.0 * F.col("hits_n") / F.col("tickers_n"))
    return rows.withColumn("hit_rate_pct", rate).orderBy(F.desc("run_time"), F.desc("id")).limit(limit)


def observation_history(observations: DataFrame, sessions: DataFrame, ticker: str, timeframe: str, since: str) -> DataFrame:
    runs = sessions.filter((F.col("timeframe") == timeframe) & (F.col("scan_time") >= F.lit(since).cast("timestamp")))
    return observations.filter(F.col("ticker") == ticker).join(runs, "session_id").orderBy("scan_time")


def single_provider(signals: DataFrame) -> DataFrame:
    """Number of distinct providers and whether a signal frame has one provider only."""
    return signals.agg(F.count_distinct("provider").alias("providers"), F.count_if(F.col("provider").isNull()).alias("missing")).withColumn(
        "valid", (F.col("providers") == 1) & (F.col("missing") == 0)
    )
