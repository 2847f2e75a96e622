"""Intraday session study: VWAP, opening drive, reclaim, trade attempts, R metrics and gates.

Windows are partitioned by (ticker, session): a session holds at most its grid (78 five-minute bars).
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import block_window, number_rows, owned, running_total
from ..operators.calendar import local_day, local_minute
from ..operators.indicators import with_indicators
from ..operators.quality import invalid_ohlc
from ..operators.ranks import expanding_rank
from ..operators.scores import add_intraday_score
from ..session import settle


@dataclass(frozen=True)
class SessionSpec:
    """Locked values of the study; the defaults are five-minute bars of a full session."""

    bar_minutes: int = 5
    drive_bars: int = 6
    prior_sessions: int = 20
    min_return_pct: float = 0.75
    min_volume_multiple: float = 1.5
    window_start: int = 600
    window_end: int = 690
    time_exit: int = 945
    target_multiple: float = 1.5
    prior_close_min: float = 5.0
    prior_dollar_volume_min: float = 50_000_000.0
    score_min: int = 40


SESSION = ["ticker", "session_date"]


def session_bars(bars: DataFrame, sessions: DataFrame, grid: DataFrame) -> DataFrame:
    """Bars of full sessions on the grid (one second tolerance), first duplicate kept, with validity and grid index."""
    from ..sources.bars import keep_one

    finite = bars.dropna(subset=["open", "high", "low", "close", "volume"])
    first = keep_one(finite, ["ticker", "ts"], "arrival", last=False) if "arrival" in bars.columns else finite
    start = F.timestamp_seconds(F.round(F.unix_micros("ts") / 1e6).cast("bigint"))
    g = F.broadcast(grid.select("session_date", "session_no", "grid_idx", "bar_start"))
    return (
        first.withColumn("bar_start", start).withColumn("session_date", local_day("ts"))
        .join(g, ["session_date", "bar_start"])
        .withColumn("valid", ~invalid_ohlc())
    )


def session_quality(bars: DataFrame, sessions: DataFrame, grid: DataFrame, on_grid: DataFrame) -> DataFrame:
    """Quality counters per ticker: rows, duplicates, off-grid, invalid, zero volume, missing, valid, sessions."""
    full = F.broadcast(sessions.filter(~F.col("is_early_close")).select("session_date", F.lit(1).alias("full")))
    raw = bars.withColumn("session_date", local_day("ts"))
    copies = raw.groupBy("ticker", "ts", "session_date").agg(F.count(F.lit(1)).alias("n"))
    totals = copies.groupBy("ticker").agg(F.sum("n").alias("total_rows"), F.sum(F.col("n") - 1).alias("duplicate_timestamps"), F.count(F.lit(1)).alias("_times"))
    seen = copies.join(full, "session_date").select("ticker", "session_date").distinct().groupBy("ticker").agg(F.count(F.lit(1)).alias("sessions"))
    size = grid.groupBy("session_date").agg(F.count(F.lit(1)).alias("_size")).agg(F.max("_size").alias("_size"))
    placed = on_grid.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_placed"), F.count_if("valid").alias("valid_bars"), F.count_if(~F.col("valid")).alias("invalid_ohlc_rows"),
        F.count_if(F.col("volume") == 0).alias("zero_volume_bars"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        totals.join(seen, "ticker", "left").join(placed, "ticker", "left").crossJoin(F.broadcast(size))
        .select(
            "ticker", "total_rows", "duplicate_timestamps", (F.col("_times") - zero("_placed")).alias("off_grid_bars"),
            *[zero(c).alias(c) for c in ("invalid_ohlc_rows", "zero_volume_bars", "valid_bars", "sessions")],
            (zero("sessions") * F.col("_size") - zero("valid_bars")).alias("missing_bars"), F.col("_size").alias("bars_per_session"),
        )
    )


def contract_reasons() -> Column:
    return F.array_compact(F.array(*[
        F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.col(c))) for c in ("off_grid_bars", "invalid_ohlc_rows")
    ]))


def sufficiency_reasons() -> Column:
    expected = F.col("sessions") * F.col("bars_per_session")
    return F.array_compact(F.array(
        F.when(F.try_divide(F.col("missing_bars"), expected) > 0.05, "missing_bar_rate_above_5%"),
        F.when(F.try_divide(F.col("zero_volume_bars"), expected) > 0.10, "zero_volume_rate_above_10%"),
        F.when(F.try_divide(F.col("duplicate_timestamps"), F.col("total_rows")) > 0.01, "duplicate_rate_above_1%"),
    ))


def removal_class(early_or_missing: Column) -> Column:
    """Class of an intraday bar against regular hours; needs ``ts``."""
    m = local_minute("ts")
    return (
        F.when(m < 570, "premarket").when(m >= 960, "after_hours").when(early_or_missing, "early_close_or_no_session")
        .when(m % 5 != 0, "off_grid").otherwise("kept")
    )


def with_vwap(on_grid: DataFrame) -> DataFrame:
    """Running volume-weighted price of valid bars, reset every session."""
    w = Window.partitionBy(*SESSION).orderBy("grid_idx").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    pv = F.sum(F.when(F.col("valid"), typical * F.col("volume"))).over(w)
    v = F.sum(F.when(F.col("valid"), F.col("volume"))).over(w)
    return on_grid.withColumn("vwap", F.when(F.col("valid") & (v > 0), F.try_divide(pv, v)))


def opening_drives(bars: DataFrame, grid: DataFrame, spec: SessionSpec) -> DataFrame:
    """State of each (ticker, session) after its first bars, with the median of prior complete sessions' volume.

    A session's volume baseline is the newest complete sessions before it, found by their running
    number and an equality join.
    """
    k = spec.drive_bars
    size = grid.groupBy("session_date").agg(F.count(F.lit(1)).alias("grid_size"))
    early = F.col("valid") & (F.col("grid_idx") < k)
    at = lambda c, i: F.max(F.when(early & (F.col("grid_idx") == i), F.col(c)))
    per = bars.groupBy(*SESSION, "session_no").agg(
        F.count_if(early).alias("_early"), F.count_if("valid").alias("_valid"), F.count(F.lit(1)).alias("_bars"),
        at("open", 0).alias("open_first"), at("close", k - 1).alias("close_at_decision"), at("vwap", k - 1).alias("vwap_at_decision"),
        F.sum(F.when(early, F.col("volume"))).alias("cumulative_volume"),
        F.max(F.when(F.col("grid_idx") == 0, F.col("open"))).alias("session_open"),
    ).join(F.broadcast(size), "session_date")
    complete = ((F.col("_valid") == F.col("grid_size")) & (F.col("_bars") == F.col("grid_size"))).cast("double")
    numbered = number_rows(per.withColumn("complete", complete), ["ticker"], "session_date")
    counted = running_total(numbered, ["ticker"], {"_done": F.col("complete")}).withColumn("_done", F.col("_done").cast("bigint"))
    base = counted.withColumn("_before", F.col("_done") - F.col("complete").cast("bigint"))
    finished = counted.filter("complete = 1").select("ticker", F.col("_done").alias("_nth"), F.col("cumulative_volume").alias("_volume"))
    n = spec.prior_sessions
    wanted = base.filter(F.col("_before") >= n).select(
        *SESSION, F.explode(F.sequence(F.col("_before") - (n - 1), F.col("_before"))).alias("_nth")
    )
    medians = wanted.join(finished, ["ticker", "_nth"]).groupBy(*SESSION).agg(F.median("_volume").alias("median_prior_volume"))
    out = base.join(medians, SESSION, "left")
    all_in = F.col("_early") == k
    ret = F.when(all_in, 100.0 * (F.col("close_at_decision") / F.col("open_first") - 1.0))
    multiple = F.when(F.col("median_prior_volume") > 0, F.col("cumulative_volume") / F.col("median_prior_volume"))
    no = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumns({"return_pct": ret, "volume_multiple": multiple, "missing_bars": F.lit(k) - F.col("_early")})
    tests = {
        "return_below_min": ~no(F.col("return_pct") >= spec.min_return_pct),
        "close_not_above_vwap": ~no(F.col("close_at_decision") > F.col("vwap_at_decision")),
        "volume_multiple_below_min_or_unavailable": ~no(F.col("volume_multiple") >= spec.min_volume_multiple),
    }
    reasons = F.array_compact(F.array(F.when(~all_in, "missing_opening_bars"), *[F.when(all_in & c, n) for n, c in tests.items()]))
    return out.withColumn("reasons", reasons).withColumn("qualified", all_in & (F.size("reasons") == 0)).select(
        *SESSION, "qualified", "return_pct", "close_at_decision", "vwap_at_decision", "cumulative_volume", "median_prior_volume",
        "volume_multiple", "missing_bars", "session_open", F.col("complete").cast("boolean").alias("complete"), "reasons",
    )


def _stop(bar_close: Column, bar_low: Column) -> Column:
    return bar_low - F.greatest(F.lit(0.01), bar_close * 0.0005)


def reclaim_signals(bars: DataFrame, drives: DataFrame, spec: SessionSpec, strategy: str, need_drive: bool) -> DataFrame:
    """First bar of the search window that dips to the VWAP and closes above it, above its open and the session open."""
    minute = local_minute("bar_start")
    looked = bars.join(drives.select(*SESSION, "qualified", "session_open"), SESSION)
    hit = looked.filter(
        F.col("valid") & (minute >= spec.window_start) & (minute < spec.window_end) & F.col("vwap").isNotNull()
        & (F.col("low") <= F.col("vwap")) & (F.col("close") > F.col("vwap")) & (F.col("close") > F.col("open"))
        & (F.col("close") >= F.col("session_open"))
    )
    if need_drive:
        hit = hit.filter("qualified")
    first = hit.groupBy(*SESSION).agg(F.min_by(F.struct("grid_idx", "low", "close"), "grid_idx").alias("b"))
    return first.select(
        *SESSION, F.lit(strategy).alias("strategy"), F.col("b.grid_idx").alias("signal_idx"), F.lit(None).cast("int").alias("score"),
        _stop(F.col("b.close"), F.col("b.low")).alias("stop_price"),
    )


def score_signals(bars: DataFrame, spec: SessionSpec, strategy: str = "baseline_a") -> DataFrame:
    """First bar completing in the window whose intraday score reaches the minimum (20 earlier bars needed)."""
    valid = bars.filter("valid").select("ticker", F.col("bar_start").alias("ts"), "session_date", "grid_idx", "open", "high", "low", "close", "volume")
    laid = with_indicators(valid, ("ticker",)).withColumn("previous_diff", F.lag("macd_diff").over(block_window(["ticker"])))
    scored = add_intraday_score(expanding_rank(settle(owned(laid)), ["ticker"], "bb_width"))
    done = local_minute("ts") + spec.bar_minutes
    hit = scored.filter((done >= spec.window_start) & (done <= spec.window_end) & (F.col("pos") >= 20) & (F.col("score") >= spec.score_min))
    first = hit.groupBy(*SESSION).agg(F.min_by(F.struct("grid_idx", "low", "close", "score"), "grid_idx").alias("b"))
    return first.select(
        *SESSION, F.lit(strategy).alias("strategy"), F.col("b.grid_idx").alias("signal_idx"), F.col("b.score").alias("score"),
        _stop(F.col("b.close"), F.col("b.low")).alias("stop_price"),
    )


def attempt_trades(signals: DataFrame, bars: DataFrame, grid: DataFrame, costs: Sequence[tuple[str, float]], spec: SessionSpec) -> DataFrame:
    """Next-bar entry, fixed stop, R-multiple target and the first exit, per cost scenario.

    A signal meets only the bars of its own session; the first exit is a minimum over grid indices.
    """
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(b)).alias("bps")) for n, b in costs])
    at_exit = local_minute("bar_start") + spec.bar_minutes == spec.time_exit
    shape = F.broadcast(grid.groupBy("session_date").agg(
        F.max("grid_idx").alias("last_idx"), F.max(F.when(at_exit, F.col("grid_idx"))).alias("exit_idx")
    ))
    valid = bars.filter("valid")
    nxt = valid.select(*SESSION, F.col("grid_idx").alias("entry_idx"), F.col("open").alias("entry_open"))
    s = (
        signals.withColumn("entry_idx", F.col("signal_idx") + 1).join(nxt, [*SESSION, "entry_idx"], "left").join(shape, "session_date")
        .withColumn("c", F.explode(scenarios)).withColumn("scenario", F.col("c.scenario"))
        .withColumn("entry_fill", F.col("entry_open") * (1 + F.col("c.bps") / 10_000))
        .withColumn("risk_per_share", F.col("entry_fill") - F.col("stop_price"))
        .withColumn("status", F.when(F.col("entry_open").isNull(), "rejected_no_next_bar")
                    .when(F.col("entry_open") <= F.col("stop_price"), "rejected_entry_at_or_below_stop")
                    .when(F.col("risk_per_share") <= 0, "rejected_nonpositive_risk").otherwise("executed"))
        .withColumn("target_price", F.col("entry_fill") + spec.target_multiple * F.col("risk_per_share"))
        .withColumn("limit_idx", F.when(F.col("entry_idx") <= F.col("exit_idx"), F.col("exit_idx")).otherwise(F.col("last_idx")))
    )
    keys = [*SESSION, "strategy", "scenario"]
    path = s.filter("status = 'executed'").join(valid.select(*SESSION, "grid_idx", "open", "high", "low", "close"), SESSION).filter(F.col("grid_idx") <= F.col("limit_idx"))
    stop, target = F.col("stop_price"), F.col("target_price")
    reason = (
        F.when(F.col("grid_idx") < F.col("entry_idx"), F.lit(None).cast("string"))
        .when(F.col("open") <= stop, "gap_stop").when(F.col("open") >= target, "gap_target")
        .when(F.col("low") <= stop, "stop").when(F.col("high") >= target, "target")
        .when(F.col("grid_idx") == F.col("exit_idx"), "time")
    )
    price = F.when(F.col("reason").startswith("gap_"), F.col("open")).when(F.col("reason") == "stop", stop).when(F.col("reason") == "target", target).otherwise(F.col("close"))
    both = F.col("reason").isin("stop") & (F.col("high") >= target)
    path = path.withColumn("reason", reason).withColumn("price", price).withColumn("ambiguous", both)
    is_exit = F.col("reason").isNotNull()
    ends = path.groupBy(*keys).agg(
        F.min_by(F.when(is_exit, F.struct("grid_idx", "reason", "price", "ambiguous")), F.when(is_exit, F.col("grid_idx"))).alias("x"),
        F.max_by(F.struct("grid_idx", "close"), "grid_idx").alias("fallback"),
    )
    out = s.join(ends, keys, "left")
    idx = F.coalesce("x.grid_idx", "fallback.grid_idx")
    raw = F.coalesce("x.price", "fallback.close")
    kind = F.when(F.col("status") == "executed", F.coalesce(F.col("x.reason"), F.lit("time_fallback")))
    out = out.withColumns({"exit_bar_idx": idx, "raw_exit_price": raw, "exit_type": kind, "same_bar_ambiguity": F.coalesce("x.ambiguous", F.lit(False))})
    steps = F.col("exit_bar_idx") - F.col("entry_idx") + F.when(F.col("exit_type").startswith("gap_"), 0).otherwise(1)
    executed = F.col("status") == "executed"
    fill = F.col("raw_exit_price") * (1 - F.col("c.bps") / 10_000)
    return out.withColumns(
        {
            "exit_fill": F.when(executed, fill),
            "net_r": F.when(executed, (fill - F.col("entry_fill")) / F.col("risk_per_share")),
            "holding_minutes": F.when(executed, F.greatest(F.lit(0.0), (steps * spec.bar_minutes).cast("double"))),
        }
    ).select(*keys, "signal_idx", "score", "status", "entry_idx", "entry_open", "entry_fill", "stop_price", "target_price", "risk_per_share",
             "exit_bar_idx", "exit_type", "raw_exit_price", "exit_fill", "net_r", "holding_minutes", "same_bar_ambiguity")
