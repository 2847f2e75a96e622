"""Feeds against the expected grid: coverage, missing sessions, and two feeds bar by bar."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calendar import local_day
from ..operators.quality import invalid_ohlc
from ..operators.stats import exact_quantiles

PRICES = ["open", "high", "low", "close"]


@dataclass(frozen=True)
class CoverageLimits:
    """Shares, in percent, that a feed must keep."""

    minimum_coverage: float = 95.0
    maximum_duplicates: float = 1.0
    maximum_zero_volume: float = 10.0


def expected_slots(series: DataFrame, grid: DataFrame) -> DataFrame:
    """Every series with every bar start of the grid: an equi-join by session.

    ``series`` has ticker, first_day and last_day, the range it was asked for; the grid is one row per expected bar.
    """
    days = series.select("ticker", F.explode(F.sequence("first_day", "last_day")).alias("session_date"))
    return days.join(grid.select("session_date", F.col("bar_start").alias("ts")), "session_date").select("ticker", "session_date", "ts")


def classified(bars: DataFrame, sessions: DataFrame, bar_minutes: int) -> DataFrame:
    """Bars with their ``class``: primary (on the grid of a full session), early_close (of a short one), off_grid or extended."""
    s = F.broadcast(sessions.select("session_date", "opens_at", "closes_at", "is_early_close"))  # one row a day
    j = bars.withColumn("session_date", local_day("ts")).join(s, "session_date", "left")
    since = (F.unix_micros("ts") - F.unix_micros("opens_at")) / 1e6
    on_grid = (since % (bar_minutes * 60) == 0) & (F.unix_micros("ts") + bar_minutes * 60_000_000 <= F.unix_micros("closes_at"))
    inside = (F.col("ts") >= F.col("opens_at")) & (F.col("ts") < F.col("closes_at"))
    label = (
        F.when(~F.coalesce(inside, F.lit(False)), "extended").when(on_grid & ~F.col("is_early_close"), "primary").when(on_grid, "early_close").otherwise("off_grid")
    )
    return j.withColumn("class", label).drop("opens_at", "closes_at", "is_early_close")


def feed_coverage(bars: DataFrame, series: DataFrame, sessions: DataFrame, grid: DataFrame, bar_minutes: int, limits: CoverageLimits = CoverageLimits()) -> DataFrame:
    """One row per series: bars by class, coverage of the grid, rates over primary bars, sessions without any bar, the verdict.

    ``bars`` may repeat a time; the first row of a time counts and the others are duplicates. ``series`` is what was asked for (ticker, first_day,
    last_day): one without any bar is covered by 0 %.
    """
    asked = bars.join(series, "ticker").filter(local_day("ts").between(F.col("first_day"), F.col("last_day"))).drop("first_day", "last_day")
    tagged = classified(asked, sessions, bar_minutes)
    per_time = tagged.groupBy("ticker", "ts", "session_date", "class").agg(F.count(F.lit(1)).alias("n"), F.first("volume").alias("volume"), F.bool_or(invalid_ohlc()).alias("bad"))
    primary = F.col("class") == "primary"
    counts = per_time.groupBy("ticker").agg(
        F.sum("n").alias("raw_rows"), F.sum(F.col("n") - 1).alias("duplicate_timestamps"), F.count_if(F.col("volume") == 0).alias("zero_volume_bars"),
        *[F.count_if(F.col("class") == c).alias(f"{c}_bars") for c in ("primary", "early_close", "extended", "off_grid")],
        F.sum(F.when(primary, F.col("n") - 1).otherwise(0)).alias("_primary_copies"), F.count_if(primary & (F.col("volume") == 0)).alias("_primary_zero"),
        F.count_if(primary & F.col("bad")).alias("invalid_primary_bars"), F.array_sort(F.collect_set(F.when(primary, F.col("session_date")))).alias("_seen"),  # bounded by the calendar
    )
    full = expected_slots(series, grid).groupBy("ticker").agg(F.count(F.lit(1)).alias("expected_bars"), F.array_sort(F.collect_set("session_date")).alias("_due"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = series.select("ticker").join(full, "ticker", "left").join(counts, "ticker", "left")
    plain = ["expected_bars", "raw_rows", "duplicate_timestamps", "zero_volume_bars", "primary_bars", "early_close_bars", "extended_bars", "off_grid_bars", "invalid_primary_bars", "_primary_copies", "_primary_zero"]
    none = F.array().cast("array<date>")
    out = out.withColumns({c: zero(c) for c in plain})
    pct = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(0.0)
    out = out.withColumns({
        "missing_bars": F.greatest(F.lit(0), F.col("expected_bars") - F.col("primary_bars")), "coverage_pct": pct("primary_bars", "expected_bars"),
        "duplicate_rate_pct": pct("_primary_copies", "primary_bars"), "zero_volume_rate_pct": pct("_primary_zero", "primary_bars"),
        "missing_sessions": F.array_except(F.coalesce("_due", none), F.coalesce("_seen", none)),
    })
    passed = (
        (F.col("coverage_pct") >= limits.minimum_coverage) & (F.col("duplicate_rate_pct") <= limits.maximum_duplicates)
        & (F.col("zero_volume_rate_pct") <= limits.maximum_zero_volume) & (F.col("invalid_primary_bars") == 0)
    )
    return out.withColumn("threshold_result", F.when(passed, "passed").otherwise("failed")).drop("_due", "_seen", "_primary_copies", "_primary_zero")


def feed_grid_comparison(a: DataFrame, b: DataFrame, series: DataFrame, grid: DataFrame) -> DataFrame:
    """One row per series: both feeds re-indexed on the expected grid, and what their common bars say.

    A bar with a missing figure is no bar. Prices agree within 1e-8 + 1e-5 of the second feed's; the median ratio is that of bars whose first
    volume is above 0. Classes: not_comparable (no feed has a bar at all), one_feed_empty, no_overlap, identical (total volumes agree as well),
    same_timestamps_different_values, different_ohlc.
    """
    cols = [*PRICES, "volume"]
    whole = lambda df, p: df.dropna(subset=cols).groupBy("ticker", "ts").agg(*[F.first(c).alias(f"{p}_{c}") for c in cols])
    slots = expected_slots(series, grid).select("ticker", "ts")
    j = slots.join(whole(a, "a"), ["ticker", "ts"], "left").join(whole(b, "b"), ["ticker", "ts"], "left")
    paired = F.col("a_close").isNotNull() & F.col("b_close").isNotNull()
    off = F.lit(False)
    for c in PRICES:
        off = off | (F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > 1e-8 + 1e-5 * F.abs(F.col(f"b_{c}")))
    j = j.withColumns({"paired": paired, "ratio": F.when(paired & (F.col("a_volume") > 0), F.col("b_volume") / F.col("a_volume"))})
    out = j.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("expected_bars"), F.count_if("paired").alias("paired_bars"), F.count_if(F.col("paired") & off).alias("ohlc_differences"),
        F.sum(F.when(F.col("paired"), F.col("a_volume"))).alias("a_volume"), F.sum(F.when(F.col("paired"), F.col("b_volume"))).alias("b_volume"),
    )
    sizes = [df.groupBy("ticker").agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "a_bars"), (b, "b_bars"))]
    out = series.select("ticker").join(out, "ticker", "left").join(exact_quantiles(j, ["ticker"], "ratio", {"median_volume_ratio": 0.5}), "ticker", "left")
    for s in sizes:
        out = out.join(s, "ticker", "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("expected_bars", "paired_bars", "ohlc_differences", "a_bars", "b_bars")})
    out = out.withColumns({"overlap_pct": F.when(F.col("expected_bars") > 0, F.col("paired_bars") / F.col("expected_bars") * 100), "volume_ratio": F.when(F.col("a_volume") > 0, F.col("b_volume") / F.col("a_volume"))})
    none_a, none_b = F.col("a_bars") == 0, F.col("b_bars") == 0
    label = (
        F.when(none_a & none_b, "not_comparable").when(none_a | none_b, "one_feed_empty").when(F.col("paired_bars") == 0, "no_overlap")
        .when((F.col("ohlc_differences") == 0) & (F.round("volume_ratio", 6) == 1.0), "identical").when(F.col("ohlc_differences") == 0, "same_timestamps_different_values")
        .otherwise("different_ohlc")
    )
    return out.withColumn("classification", label)


def session_days(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Close and volume of every regular session out of intraday bars of any length."""
    s = F.broadcast(sessions.select("session_date", "opens_at", "closes_at"))  # one row a day
    inside = bars.withColumn("session_date", local_day("ts")).join(s, "session_date").filter((F.col("ts") >= F.col("opens_at")) & (F.col("ts") < F.col("closes_at")))
    return inside.groupBy("ticker", "session_date").agg(F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def timeframe_parity(bars: DataFrame, reference: DataFrame, sessions: DataFrame, tolerance_pct: float) -> DataFrame:
    """Bars of two lengths, each summed up to sessions: one row per session of the reference with the differences in percent and the verdict.

    A session that ``bars`` lacks is ``missing``; one beyond the tolerance in close or volume is a ``mismatch``.
    """
    a = session_days(bars, sessions).withColumnsRenamed({"close": "other_close", "volume": "other_volume"})
    j = session_days(reference, sessions).join(a, ["ticker", "session_date"], "left")
    off = lambda c: F.abs(F.col(f"other_{c}") - F.col(c)) / F.greatest(F.col(c), F.lit(1e-9)) * 100
    j = j.withColumns({"close_diff_pct": off("close"), "volume_diff_pct": off("volume")})
    far = (F.col("close_diff_pct") > tolerance_pct) | (F.col("volume_diff_pct") > tolerance_pct)
    verdict = F.when(F.col("other_close").isNull(), "missing").when(far, "mismatch").otherwise("ok")
    return j.select("ticker", "session_date", "close_diff_pct", "volume_diff_pct", verdict.alias("verdict"))


def ticker_checks(bars: DataFrame, start: str, end: str, lookback: int, holding: int) -> DataFrame:
    """One row per ticker of a pattern snapshot: rows dropped by reason, and the bars with a full look-back or enough bars ahead.

    ``bars`` has ``arrival``; the last row of a time is kept. Bars outside [start, end] go next, then rows that break the price rules or lack a
    figure. ``missing_required_values`` counts figures, the others rows.
    """
    cols = [*PRICES, "volume"]
    kept = bars.groupBy("ticker", "ts").agg(F.max_by(F.struct(*cols), "arrival").alias("r"), F.count(F.lit(1)).alias("n")).select("ticker", "ts", "n", "r.*")
    inside = F.to_date("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    absent = [F.when(F.col(c).isNull() | F.isnan(c), 1).otherwise(0) for c in cols]
    endless = F.greatest(*[F.abs(c) for c in cols]) == float("inf")
    bad = F.coalesce(invalid_ohlc() | (F.least(*PRICES) <= 0) | (F.col("volume") < 0) | endless, F.lit(True)) | (sum(absent, F.lit(0)) > 0)
    good = inside & ~bad
    out = kept.groupBy("ticker").agg(
        F.sum(F.col("n") - 1).alias("duplicate_timestamps"), F.count_if(~inside).alias("bars_outside_range"), F.sum(F.when(inside, sum(absent, F.lit(0))).otherwise(0)).alias("missing_required_values"),
        F.count_if(inside & bad).alias("invalid_ohlc_rows"), F.count_if(good).alias("bars"),
    )
    full = lambda n: F.greatest(F.lit(0), F.col("bars") - n)
    return out.withColumns({"complete_lookbacks": full(lookback - 1), "complete_forward_bars": full(holding)})
