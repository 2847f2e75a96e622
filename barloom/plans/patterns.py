"""Price patterns: event mining, fingerprints, matching, point-in-time observations and trades."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SIMILARITY_WEIGHTS, PatternProfile, Split
from ..functions.numbers import half_even, similarity
from ..functions.returns import directed_return_pct, slippage_key
from ..operators.blocks import BLOCK_ROWS, HALO_ROWS, block_window, lay_out, number_rows, owned, place_rows
from ..operators.calendar import in_split
from ..operators.greedy import choose_non_overlapping
from ..operators.indicators import INDICATOR_COLUMNS, add_indicators_to_blocks, indicator_frame
from ..operators.stats import exact_quantiles
from ..session import settle

# Stored series and the decimals kept of each.
SERIES_DECIMALS = {"price_pct": 4, "volume_ratio": 4, "rsi": 2, "macd_diff": 4, "bb_width": 4, "atr": 4}
_RAW = ["close", "volume", "rsi", "macd_diff", "bb_width", "atr"]


def complete_frame(bars: DataFrame, keys: Sequence[str] = ("ticker",), required: Sequence[str] = INDICATOR_COLUMNS) -> DataFrame:
    """Bars whose required indicators are all known, renumbered per series."""
    keys = list(keys)
    frame = indicator_frame(bars, keys).drop("pos", "prev_close")
    return number_rows(frame.dropna(subset=list(required)), keys)


def _rounding(get, digits: int):
    return lambda x: half_even(get(x), digits)


def _field(name: str):
    return lambda p: p[name]


def _window_series(window: Column) -> Column:
    """Normalised series of a window array as a struct of arrays."""
    base = window[0]["close"]
    volume = F.aggregate(window, F.lit(0.0), lambda s, x: s + x["volume"]) / F.size(window)
    pick = {
        "price_pct": lambda x: (F.try_divide(x["close"], base) - 1) * 100,
        "volume_ratio": lambda x: F.try_divide(x["volume"], volume),
        "rsi": lambda x: x["rsi"],
        "macd_diff": lambda x: x["macd_diff"],
        "bb_width": lambda x: x["bb_width"],
        "atr": lambda x: x["atr"],
    }
    parts = [
        F.transform(window, _rounding(pick[n], SERIES_DECIMALS[n])).alias(n) for n in pick
    ]
    usable = (F.size(window) >= 5) & (base != 0) & (volume != 0)
    return F.when(usable, F.struct(*parts))


def _past_window(keys: Sequence[str], first: int, last: int) -> Column:
    return F.collect_list(F.struct(*_RAW)).over(block_window(keys).rowsBetween(first, last))


def mine_events(
    frame: DataFrame, profile: PatternProfile, first_pos: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Non-overlapping run-ups and declines of a complete frame with the window before each.

    The walk starts at ``first_pos``; windows that do not fit are dropped after the walk.
    """
    days, look = profile.move_days, profile.lookback_days
    w = block_window(["ticker"])
    placed = place_rows(frame, ["ticker"], look, days, block_rows)
    looked = owned(
        placed.withColumns({"future_close": F.lead("close", days).over(w), "window": _past_window(["ticker"], -look, -1)})
    )
    move = (F.col("future_close") - F.col("close")) / F.col("close") * 100
    kinds = F.array_compact(
        F.array(
            F.when(F.col("move") >= profile.runup_pct, F.lit("runup")),
            F.when(F.col("move") <= -profile.decline_pct, F.lit("decline")),
        )
    )
    candidates = (
        looked.filter(F.col("future_close").isNotNull() & (F.col("close") != 0) & (F.col("pos") >= first_pos))
        .withColumn("move", move)
        .withColumn("event_type", F.explode(kinds))
        .withColumn("free_at", F.col("pos") + days)
    )
    candidates = settle(candidates)
    chosen = choose_non_overlapping(
        candidates.select("ticker", "event_type", "pos", "free_at"), ["ticker", "event_type"], "pos", "free_at", 4_096
    )
    return (
        candidates.join(chosen, ["ticker", "event_type", "pos"])
        .filter(F.col("pos") >= look)
        .withColumn("series", _window_series(F.col("window")))
        .filter(F.col("series").isNotNull())
        .select(
            "ticker", "event_type", F.to_date("ts").alias("event_date"), half_even(F.col("move"), 2).alias("move_pct"),
            F.col("close").alias("event_close"), "future_close", "series",
        )
    )


def _series_points(events: DataFrame, names: Sequence[str], n: int) -> DataFrame:
    """(event keys, series, idx, value), padded on the left with the first value to n points."""
    def fit(a: Column) -> Column:
        short = F.greatest(F.lit(n) - F.size(a), F.lit(0))
        return F.slice(F.concat(F.array_repeat(a[0], short), a), -n, n)
    rows = F.array(*[F.struct(F.lit(s).alias("series"), fit(F.col(f"series.{s}")).alias("values")) for s in names])
    return events.withColumn("_s", F.explode(rows)).select(
        "ticker", "event_type", "event_date", F.col("_s.series").alias("series"), F.posexplode("_s.values").alias("idx", "value")
    )


def fingerprint_points(
    events: DataFrame, profile: PatternProfile, names: Sequence[str] = tuple(SERIES_DECIMALS), from_rounded: bool = False
) -> DataFrame:
    """Mean, deviation and bands per (event type, series, idx); types with too few events are left out."""
    enough = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events")).filter(F.col("n_events") >= profile.min_events)
    stats = _series_points(events, names, profile.lookback_days).groupBy("event_type", "series", "idx").agg(
        F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")
    )
    mean, std = half_even(F.col("_m"), 4), half_even(F.col("_s"), 4)
    a, b = (mean, std) if from_rounded else (F.col("_m"), F.col("_s"))
    return stats.join(enough, "event_type").select(
        "event_type", "n_events", "series", "idx", mean.alias("mean"), std.alias("std"),
        half_even(a + b, 4).alias("upper"), half_even(a - b, 4).alias("lower"),
    )


def fingerprints(points: DataFrame, profile_name: str, source: str, lookback: int) -> DataFrame:
    """One row per (event type, profile, source, series) with the four vectors."""
    vectors = F.array_sort(F.collect_list(F.struct("idx", "mean", "std", "upper", "lower")))
    out = points.groupBy("event_type", "n_events", "series").agg(vectors.alias("_v"))
    return out.select(
        "event_type", F.lit(profile_name).alias("profile"), F.lit(source).alias("source"), F.current_timestamp().alias("created_at"),
        "n_events", F.lit(lookback).alias("lookback_days"), "series",
        *[F.transform("_v", _field(f)).alias(f) for f in ("mean", "std", "upper", "lower")],
    )


def full_build(bars: DataFrame, profile_name: str, profile: PatternProfile, source: str) -> DataFrame:
    """Mine and build the fingerprints of both event types."""
    events = mine_events(complete_frame(bars), profile)
    return fingerprints(fingerprint_points(events, profile), profile_name, source, profile.lookback_days)


def fingerprint_means(points: DataFrame) -> DataFrame:
    """One small row per event type: the mean vector of every matched series."""
    vec = lambda s: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("series") == s, F.struct("idx", "mean")))), lambda p: p["mean"]
    )
    return points.groupBy("event_type").agg(
        F.first("n_events").alias("fp_events"), *[vec(s).alias(f"fp_{s}") for s in SIMILARITY_WEIGHTS]
    )


def _similarity_columns(live: str) -> dict[str, Column]:
    each = {f"score_{s}": similarity(F.col(f"{live}.{s}"), F.col(f"fp_{s}")) for s in SIMILARITY_WEIGHTS}
    return each


def _weighted() -> Column:
    total = sum(SIMILARITY_WEIGHTS.values())
    return half_even(sum((F.col(f"score_{s}") * w for s, w in SIMILARITY_WEIGHTS.items()), F.lit(0.0)) / total, 1)


# Interpretation texts per tier.
MATCH_NOTES = {
    "high": "High shape similarity to the stored fingerprint. Predictive value is unvalidated.",
    "moderate": "Moderate shape similarity to the stored fingerprint. Predictive value is unvalidated.",
    "low": "Low shape similarity to the stored fingerprint. Predictive value is unvalidated.",
}


def match_screen(bars: DataFrame, points: DataFrame, profile: PatternProfile, rows: int = 60, min_similarity: float | None = None) -> DataFrame:
    """Latest window of every ticker against the fingerprints of all event types, best first."""
    from .screener import recent_indicator_frame

    look = profile.lookback_days
    recent = recent_indicator_frame(bars, rows).drop("own", "blk").dropna(subset=INDICATOR_COLUMNS)
    w = Window.partitionBy("ticker").orderBy("pos")  # at most ``rows`` bars per ticker
    last = (
        recent.withColumn("window", F.collect_list(F.struct(*_RAW)).over(w.rowsBetween(-(look - 1), 0)))
        .groupBy("ticker").agg(F.max_by("window", "pos").alias("window"))
        .filter(F.size("window") == look)
        .withColumn("live", _window_series(F.col("window")))
        .filter(F.col("live").isNotNull())
    )
    fps = F.broadcast(fingerprint_means(points))  # one row per event type
    limit = profile.alert_threshold if min_similarity is None else min_similarity
    s = F.col("similarity_score")
    scored = (
        last.crossJoin(fps).withColumns(_similarity_columns("live")).withColumn("similarity_score", _weighted()).filter(s >= limit)
    )
    return scored.select(
        "ticker", "event_type", "similarity_score", "fp_events", *[f"score_{n}" for n in SIMILARITY_WEIGHTS],
        F.when(s >= 90, "very strong").when(s >= profile.alert_threshold, "strong").when(s >= 60, "moderate").otherwise("weak").alias("match_tier"),
        F.when(s >= F.least(F.lit(90.0), F.lit(profile.alert_threshold)), MATCH_NOTES["high"])
        .when(s >= 60, MATCH_NOTES["moderate"]).otherwise(MATCH_NOTES["low"]).alias("interpretation"),
    ).orderBy(F.desc("similarity_score"), "ticker", "event_type")


# ---- point-in-time study ------------------------------------------------------------------------

STUDY_REQUIRED = ["rsi", "macd_diff", "bb_width"]


def split_frame(bars: DataFrame, splits: Sequence[Split]) -> DataFrame:
    """Indicators computed inside each split only, so no split sees another one's history."""
    tagged = bars.withColumn("split", in_split(F.to_date("ts"), splits)).filter(F.col("split").isNotNull())
    return complete_frame(tagged, ["ticker", "split"], STUDY_REQUIRED)


def development_events(frame: DataFrame, profile: PatternProfile) -> DataFrame:
    """Events of the development split; the walk starts where a window first fits."""
    dev = frame.filter("split = 'development'").drop("split")
    return mine_events(dev, profile, first_pos=profile.lookback_days)


def observations(
    frame: DataFrame, points: DataFrame, profile: PatternProfile, holding: int, threshold: float,
    slippage: Sequence[float] = (0.0, 5.0, 10.0), splits: Sequence[str] = ("validation", "holdout"), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per decision bar and event type: similarity, qualification and the outcome inside the split."""
    keys, look = ["ticker", "split"], profile.lookback_days
    w = block_window(keys)
    placed = place_rows(frame.filter(F.col("split").isin(*splits)), keys, look, holding, block_rows)
    looked = owned(
        placed.withColumns(
            {
                "window": _past_window(keys, -(look - 1), 0),
                "entry_ts": F.lead("ts", 1).over(w), "entry_open": F.lead("open", 1).over(w),
                "exit_ts": F.lead("ts", holding).over(w), "exit_close": F.lead("close", holding).over(w),
            }
        )
    ).filter(F.size("window") == look)
    fps = F.broadcast(fingerprint_means(points))
    scored = (
        looked.withColumn("live", _window_series(F.col("window"))).filter(F.col("live").isNotNull())
        .crossJoin(fps).withColumns(_similarity_columns("live")).withColumn("similarity_score", _weighted())
    )
    done = F.col("exit_close").isNotNull()
    gross = (F.col("exit_close") - F.col("entry_open")) / F.col("entry_open") * 100
    down = F.col("event_type") == "decline"
    nets = [
        F.when(done, F.when(down, directed_return_pct(F.col("entry_open"), F.col("exit_close"), s, True))
               .otherwise(directed_return_pct(F.col("entry_open"), F.col("exit_close"), s, False))).alias(f"net_return_pct_{slippage_key(s)}bps")
        for s in slippage
    ]
    return scored.select(
        "ticker", "split", "event_type", "pos", F.to_date("ts").alias("decision_date"), "similarity_score",
        *[f"score_{n}" for n in SIMILARITY_WEIGHTS],
        (F.col("similarity_score") >= threshold).alias("is_qualifying"),
        F.col("close").alias("signal_close"),
        F.when(done, F.to_date("entry_ts")).alias("entry_date"), F.when(done, F.to_date("exit_ts")).alias("exit_date"),
        F.when(done, half_even(F.col("entry_open"), 4)).alias("raw_entry_price"),
        F.when(done, half_even(F.col("exit_close"), 4)).alias("raw_exit_price"),
        F.when(done, half_even(F.when(down, -gross).otherwise(gross), 4)).alias("gross_return_pct"),
        *nets,
        F.when(done, "complete").otherwise("insufficient_future_bars").alias("outcome_status"),
    )


def executable_trades(obs: DataFrame, holding: int) -> DataFrame:
    """One active trade per ticker, split and event type; the next decision is at or after the last exit."""
    keys = ["ticker", "split", "event_type"]
    ready = obs.filter(F.col("is_qualifying") & (F.col("outcome_status") == "complete")).withColumn("free_at", F.col("pos") + holding)
    chosen = choose_non_overlapping(ready, keys, "pos", "free_at", max(4_096, holding + 1))
    return ready.join(chosen, [*keys, "pos"]).drop("free_at")


def matched_controls(obs: DataFrame, seed: int) -> DataFrame:
    """As many non-signals as signals per (ticker, split, year, event type), those of the smallest md5 over ``seed:ticker:date``.

    Ranks are taken inside hash slices with carried counts, so a hot cell is not sorted in one task.
    """
    cell = ["ticker", "split", "event_type", "year"]
    tagged = obs.filter("outcome_status = 'complete'").withColumn("year", F.year("decision_date"))
    wanted = tagged.groupBy(*cell).agg(F.count_if("is_qualifying").alias("signals"), F.count_if(~F.col("is_qualifying")).alias("pool"))
    pool = tagged.filter(~F.col("is_qualifying")).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), "ticker", F.col("decision_date").cast("string")).cast("binary")))
    pool = pool.withColumn("_slice", F.substring("_h", 1, 2))
    below = Window.partitionBy(*cell).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = pool.groupBy(*cell, "_slice").agg(F.count(F.lit(1)).alias("_n")).select(
        *cell, "_slice", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_base")
    )
    rank = F.row_number().over(Window.partitionBy(*cell, "_slice").orderBy("_h", "decision_date"))
    ranked = pool.withColumn("_rank", rank).join(starts, [*cell, "_slice"]).join(wanted, cell)
    return (
        ranked.filter(F.col("_base") + F.col("_rank") <= F.col("signals"))
        .withColumn("underfilled", F.col("pool") < F.col("signals"))
        .drop("_h", "_slice", "_rank", "_base", "signals", "pool")
    )


def returns_distribution(obs: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """p05..p95, mean and win rate of complete returns."""
    rows = obs.filter(F.col(value).isNotNull())
    qs = {f"p{int(q * 100):02d}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)}
    moments = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), (F.count_if(F.col(value) > 0) / F.count(F.lit(1)) * 100).alias("win_rate_pct")
    )
    return moments.join(exact_quantiles(rows, groups, value, qs), list(groups))


def overlap_counts(trades_or_signals: DataFrame, holding: int) -> DataFrame:
    """Consecutive qualifying signals of one ticker whose holding periods overlap."""
    keys = ["ticker", "split", "event_type"]
    spaced = number_rows(trades_or_signals.withColumn("ts", F.col("decision_date").cast("timestamp")).withColumnRenamed("pos", "bar_pos"), keys)
    placed = place_rows(spaced, keys, 0, 1)
    nxt = F.lead("bar_pos", 1).over(block_window(keys))
    return owned(placed.withColumn("_next", nxt)).groupBy("split", "event_type").agg(
        F.count(F.lit(1)).alias("signals"), F.count_if(F.col("_next") < F.col("bar_pos") + holding).alias("overlapping")
    )


def pooled_and_ticker_rows(obs: DataFrame, value: str) -> DataFrame:
    """Pooled and per-ticker means in one pass of grouping sets; the pooled row has ticker ALL."""
    rows = obs.filter(F.col(value).isNotNull())
    return (
        rows.groupingSets([["split", "event_type"], ["split", "event_type", "ticker"]], "split", "event_type", "ticker")
        .agg(F.grouping("ticker").alias("_pooled"), F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean_return_pct"),
             (F.count_if(F.col(value) > 0) / F.count(F.lit(1)) * 100).alias("positive_pct"))
        .withColumn("ticker", F.when(F.col("_pooled") == 1, "ALL").otherwise(F.col("ticker"))).drop("_pooled")
    )


def ticker_metrics(obs: DataFrame, value: str) -> DataFrame:
    """Per ticker: observations, signals, mean signal and baseline return, lift in basis points, win rate."""
    done = F.col("outcome_status") == "complete"
    hit = done & F.col("is_qualifying")
    m = obs.groupBy("split", "event_type", "ticker").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(hit).alias("qualifying_signals"),
        F.sum(F.when(hit, F.col(value))).alias("_sum"), F.avg(F.when(hit, F.col(value))).alias("mean_net_return_pct"),
        F.avg(F.when(done, F.col(value))).alias("mean_baseline_return_pct"),
        F.avg(F.when(hit, (F.col(value) > 0).cast("double"))).alias("win_rate"),
    )
    return m.withColumn("lift_bps", (F.col("mean_net_return_pct") - F.col("mean_baseline_return_pct")) * 100)


def period_metrics(obs: DataFrame, value: str) -> DataFrame:
    """One row per split and event type over the qualifying observations.

    ``obs`` should be a stored table: it is read once per group of measures.
    """
    cell = ["split", "event_type"]
    hits = obs.filter((F.col("outcome_status") == "complete") & F.col("is_qualifying"))
    v = F.col(value)
    counts = obs.groupBy(*cell).agg(F.count(F.lit(1)).alias("eligible_observations"), F.count_if(F.col("outcome_status") != "complete").alias("missing_data_count"))
    base = hits.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("qualifying_signals"), F.min("decision_date").alias("date_start"), F.max("decision_date").alias("date_end"),
        F.avg("similarity_score").alias("mean_similarity"), F.avg("gross_return_pct").alias("mean_gross_return_pct"), F.avg(v).alias("mean_net_return_pct"),
        F.avg((v > 0).cast("double")).alias("win_rate"),
        F.array_sort(F.collect_set("decision_date")).alias("_dates"),  # bounded by the calendar
    )
    tickers = ticker_metrics(obs, value).groupBy(*cell).agg(
        F.count_if(F.col("qualifying_signals") > 0).alias("ticker_count"),
        (F.max("qualifying_signals") / F.sum("qualifying_signals")).alias("max_ticker_concentration"),
        F.try_divide(F.max(F.abs("_sum")), F.abs(F.sum("_sum"))).alias("max_contribution_concentration"),
        F.median("lift_bps").alias("median_ticker_lift_bps"), F.avg((F.col("lift_bps") > 0).cast("double")).alias("pct_tickers_positive_lift"),
    )
    middle = base.select(*cell, F.get("_dates", F.floor(F.size("_dates") / 2).cast("int")).alias("_mid"))
    halves = hits.join(F.broadcast(middle), cell).groupBy(*cell).agg(
        F.avg(F.when(F.col("decision_date") <= F.col("_mid"), v)).alias("first_half_mean_return_pct"),
        F.avg(F.when(F.col("decision_date") > F.col("_mid"), v)).alias("second_half_mean_return_pct"),
    )
    similarity_q = exact_quantiles(hits, cell, "similarity_score", {f"similarity_p{int(q * 100):02d}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)})
    median = exact_quantiles(hits, cell, value, {"median_net_return_pct": 0.5})
    out = counts.join(base.drop("_dates"), cell)
    for part in (tickers, halves, similarity_q, median):
        out = out.join(part, cell, "left")
    return out
