"""Pre-market gap scan over any number of (ticker, session) requests in one plan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GAP_TIERS, GapScanConfig
from ..operators.calendar import at_local, local_day, local_minute
from ..operators.quality import reason_codes

PREMARKET_OPEN_MINUTE = 240


def daily_from_intraday(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Daily bars of the regular hours of full sessions."""
    s = F.broadcast(sessions.filter(~F.col("is_early_close")).select("session_date", "opens_at", "closes_at"))
    kept = bars.withColumn("session_date", local_day("ts")).join(s, "session_date").filter(
        (F.col("ts") >= F.col("opens_at")) & (F.col("ts") < F.col("closes_at"))
    )
    at = F.unix_micros("ts")
    return kept.groupBy("ticker", "session_date").agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"),
    )


def snapshots(requests: DataFrame, bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Pre-market aggregate per request: bars from 04:00 local up to the open and the as-of time."""
    s = F.broadcast(sessions.select("session_date", "opens_at"))
    pre = bars.withColumn("session_date", local_day("ts")).filter(local_minute("ts") >= PREMARKET_OPEN_MINUTE)
    inside = pre.join(s, "session_date").filter(F.col("ts") < F.col("opens_at")).join(
        requests.select("ticker", "session_date", "as_of"), ["ticker", "session_date"]
    ).filter(F.col("ts") <= F.col("as_of"))
    at = F.unix_micros("ts")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    snap = inside.groupBy("ticker", "session_date").agg(
        F.count(F.lit(1)).alias("bar_count"), F.min("ts").alias("first_bar_time"), F.max("ts").alias("last_bar_time"),
        F.min_by("open", at).alias("premarket_open"), F.max("high").alias("premarket_high"), F.min("low").alias("premarket_low"),
        F.max_by("close", at).alias("premarket_last"), F.sum("volume").alias("premarket_volume"),
        F.sum(typical * F.col("volume")).alias("premarket_dollar_volume"), F.first("as_of").alias("_as_of"),
        F.count_if(F.size(reason_codes()) > 0).alias("bad_bars"),
    )
    return snap.withColumns(
        {
            "premarket_vwap": F.when(F.col("premarket_volume") > 0, F.try_divide(F.col("premarket_dollar_volume"), F.col("premarket_volume"))),
            "data_age_minutes": (F.unix_micros("_as_of") - F.unix_micros("last_bar_time")) / 6e7,
        }
    ).drop("_as_of")


def liquidity_baselines(requests: DataFrame, daily: DataFrame, sessions: DataFrame, lookback: int) -> DataFrame:
    """Mean and median volume and dollar volume of the prior sessions, and the previous close.

    Every request is exploded to its prior session numbers and joined on (ticker, session number).
    """
    numbers = F.broadcast(sessions.select("session_date", "session_no"))
    numbered = daily.join(numbers, "session_date").select(
        "ticker", F.col("session_no").alias("prior_no"), "close", "volume", (F.col("close") * F.col("volume")).alias("dollar"),
    ).filter(F.col("close").isNotNull() & F.col("volume").isNotNull())
    r = requests.select("ticker", "session_date").join(numbers, "session_date")
    wanted = r.withColumn("prior_no", F.explode(F.sequence(F.col("session_no") - lookback, F.col("session_no") - 1)))
    return wanted.join(numbered, ["ticker", "prior_no"]).groupBy("ticker", "session_date").agg(
        F.count(F.lit(1)).alias("liquidity_lookback_sessions"),
        F.avg("volume").alias("average_daily_volume"), F.median("volume").alias("median_daily_volume"),
        F.avg("dollar").alias("average_daily_dollar_volume"), F.median("dollar").alias("median_daily_dollar_volume"),
        F.max(F.when(F.col("prior_no") == F.col("session_no") - 1, F.col("close"))).alias("prev_close"),
    )


def spread_bps(bid: Column, ask: Column, quote_at: Column, as_of: Column) -> Column:
    """Spread in basis points; NULL for a crossed, nonpositive, non-finite or future quote."""
    inf = F.lit(float("inf"))
    ok = (
        bid.isNotNull() & ask.isNotNull() & ~F.isnan(bid) & ~F.isnan(ask) & (bid < inf) & (ask < inf)
        & (bid > 0) & (ask >= bid) & (quote_at.isNull() | (quote_at <= as_of))
    )
    return F.when(ok, (ask - bid) / ((bid + ask) / 2.0) * 10_000.0)


def gap_tier(gap: Column) -> Column:
    out = F.when(F.abs(gap) >= GAP_TIERS["massive"], "massive")
    return out.when(F.abs(gap) >= GAP_TIERS["large"], "large").when(F.abs(gap) >= GAP_TIERS["moderate"], "moderate").otherwise("small")


def gap_direction(gap: Column) -> Column:
    return F.when(gap > 0, "up").when(gap < 0, "down").otherwise("flat")


# ---- catalysts ----------------------------------------------------------------------------------

# Statuses that count as a catalyst.
CATALYSTS = ["earnings_today", "earnings_soon", "recent_headline", "earnings_and_recent_headline"]


def earnings_status(next_earnings: Column, session: Column, lookback_hours: float) -> Column:
    days = F.datediff(next_earnings, session)
    window = max(1, int(lookback_hours / 24.0 + 0.999999))
    return (
        F.when(next_earnings.isNull(), "unavailable").when(days == 0, "earnings_today")
        .when((days > 0) & (days <= window), "earnings_soon").when(days > window, "none_detected").otherwise("unavailable")
    )


def newest_headlines(requests: DataFrame, headlines: DataFrame, lookback_hours: float) -> DataFrame:
    """Newest headline at or before the as-of time within the look-back; ties by title, url, publisher.

    Requests and headlines meet on (ticker, day) with the few days of the look-back exploded.
    """
    clean = lambda c: F.when(F.trim(c) != "", F.substring(F.trim(c), 1, 500))
    h = headlines.select(
        "ticker", "published_at", clean(F.col("title")).alias("title"), clean(F.col("url")).alias("url"), clean(F.col("publisher")).alias("publisher"),
        F.to_date("published_at").alias("day"),
    ).filter(F.col("title").isNotNull())
    span = F.expr(f"INTERVAL {int(lookback_hours * 3600)} SECONDS")
    r = requests.select("ticker", "session_date", "as_of").withColumn(
        "day", F.explode(F.sequence(F.to_date(F.col("as_of") - span), F.to_date("as_of")))
    )
    hit = r.join(h, ["ticker", "day"]).filter((F.col("published_at") <= F.col("as_of")) & (F.col("published_at") >= F.col("as_of") - span))
    order = F.struct(-F.unix_micros("published_at"), "title", F.coalesce("url", F.lit("")), F.coalesce("publisher", F.lit("")))
    best = hit.groupBy("ticker", "session_date").agg(F.min_by(F.struct("published_at", "title", "url", "publisher"), order).alias("h"))
    return best.select(
        "ticker", "session_date", F.col("h.published_at").alias("headline_published_at"), F.col("h.title").alias("headline_title"),
        F.col("h.url").alias("headline_url"), F.col("h.publisher").alias("headline_publisher"),
    )


def catalyst_status(earnings: Column, headline: Column) -> Column:
    """Combined status of an earnings status and a headline status."""
    near = earnings.isin("earnings_today", "earnings_soon")
    recent = headline == "recent_headline"
    either = lambda s: (earnings == s) | (headline == s)
    return (
        F.when(near & recent, "earnings_and_recent_headline").when(near, earnings).when(recent, "recent_headline")
        .when(either("unavailable"), "unavailable").when(either("none_detected"), "none_detected").otherwise("not_requested")
    )


def catalysts(requests: DataFrame, earnings: DataFrame, headlines: DataFrame, lookback_hours: float) -> DataFrame:
    best = newest_headlines(requests, headlines, lookback_hours)
    out = requests.select("ticker", "session_date").join(earnings.select("ticker", "next_earnings"), "ticker", "left").join(best, ["ticker", "session_date"], "left")
    e = earnings_status(F.col("next_earnings"), F.col("session_date"), lookback_hours)
    h = F.when(F.col("headline_title").isNotNull(), "recent_headline").otherwise("none_detected")
    return out.withColumn("catalyst_status", catalyst_status(e, h)).withColumn("days_until_earnings", F.datediff("next_earnings", "session_date"))


# ---- scan ---------------------------------------------------------------------------------------

def _filters(config: GapScanConfig) -> list[tuple[Column, str, Column]]:
    """(fails, status, reason text) of the filters, in the order that decides the primary status."""
    ratio, spread = F.col("premarket_volume_ratio"), F.col("spread_bps")
    out = [(F.abs("gap_pct") < config.min_abs_gap_pct, "below_gap_threshold", F.lit(f"gap below {config.min_abs_gap_pct}%"))]
    if config.min_price > 0:
        out.append((F.coalesce("premarket_last", F.lit(0.0)) < config.min_price, "price_filtered", F.lit(f"price below ${config.min_price}")))
    if config.max_data_age_minutes is not None:
        out.append((F.col("data_age_minutes") > config.max_data_age_minutes, "stale_data",
                    F.format_string(f"data age %.1fm exceeds {config.max_data_age_minutes}m", "data_age_minutes")))
    if config.min_premarket_volume > 0:
        out.append((F.col("premarket_volume") < config.min_premarket_volume, "liquidity_filtered",
                    F.concat(F.lit("pre-market volume "), F.col("premarket_volume").cast("bigint"), F.lit(f" below {config.min_premarket_volume}"))))
    if config.min_premarket_dollar_volume > 0:
        out.append((F.col("premarket_dollar_volume") < config.min_premarket_dollar_volume, "liquidity_filtered",
                    F.lit(f"pre-market dollar volume below ${config.min_premarket_dollar_volume:,.0f}")))
    if config.min_premarket_volume_ratio > 0:
        out.append((ratio.isNull(), "liquidity_filtered", F.lit("volume ratio unavailable")))
        out.append((ratio < config.min_premarket_volume_ratio, "liquidity_filtered",
                    F.format_string(f"volume ratio %.2fx below {config.min_premarket_volume_ratio}x", "premarket_volume_ratio")))
    if config.require_spread:
        out.append((spread.isNull(), "spread_unavailable", F.lit("spread data required but unavailable")))
    if config.max_spread_bps is not None:
        out.append((spread > config.max_spread_bps, "spread_filtered",
                    F.format_string(f"spread %.1f bps exceeds {config.max_spread_bps} bps", "spread_bps")))
    if config.require_catalyst:
        out.append((~F.coalesce(F.col("catalyst_status").isin(CATALYSTS), F.lit(False)), "catalyst_filtered", F.lit("catalyst context required but not found")))
    return out


def scan_gaps(
    requests: DataFrame, premarket_bars: DataFrame, daily: DataFrame, sessions: DataFrame, config: GapScanConfig,
    quotes: DataFrame | None = None, catalyst_rows: DataFrame | None = None,
) -> DataFrame:
    """One observation per request (ticker, session_date, as_of): status, gap, snapshot, baseline, reasons."""
    base = requests.join(liquidity_baselines(requests, daily, sessions, config.liquidity_lookback_sessions), ["ticker", "session_date"], "left")
    out = base.join(snapshots(requests, premarket_bars, sessions), ["ticker", "session_date"], "left")
    out = out.join(F.broadcast(sessions.select("session_date", "opens_at")), "session_date", "left")
    if quotes is not None:
        out = out.join(quotes.select("ticker", "session_date", "bid", "ask", "quote_at"), ["ticker", "session_date"], "left").withColumn(
            "spread_bps", spread_bps(F.col("bid"), F.col("ask"), F.col("quote_at"), F.col("as_of"))
        )
    else:
        out = out.withColumn("spread_bps", F.lit(None).cast("double"))
    if catalyst_rows is not None:
        out = out.join(catalyst_rows, ["ticker", "session_date"], "left")
    else:
        out = out.withColumn("catalyst_status", F.lit("not_requested"))
    start = at_local(F.col("session_date"), PREMARKET_OPEN_MINUTE)
    gap = (F.col("premarket_last") - F.col("prev_close")) / F.col("prev_close") * 100.0
    usable = (F.col("prev_close") > 0) & F.col("premarket_last").isNotNull()
    out = out.withColumns(
        {
            "gap_pct": F.when(usable, gap),
            "premarket_volume_ratio": F.when(F.col("average_daily_volume") > 0, F.col("premarket_volume") / F.col("average_daily_volume")),
            "premarket_move_pct": F.when(F.col("premarket_open") > 0, (F.col("premarket_last") / F.col("premarket_open") - 1.0) * 100.0),
            "premarket_range_pct": F.when(
                (F.col("prev_close") > 0) & (F.col("premarket_low") > 0), (F.col("premarket_high") - F.col("premarket_low")) / F.col("prev_close") * 100.0
            ),
        }
    )
    checks = _filters(config)
    fired = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("status"), t.alias("reason"))) for c, s, t in checks]))
    early = F.col("as_of") < start
    late = F.lit(False) if config.allow_after_open else F.col("as_of") >= F.col("opens_at")
    status = (
        F.when(F.col("opens_at").isNull(), "non_trading_day").when(early | late, "outside_premarket_session")
        .when(F.col("prev_close").isNull() | (F.col("prev_close") <= 0), "no_previous_close")
        .when(F.col("bar_count").isNull(), "no_premarket_data")
        .when(F.col("bad_bars") > 0, "calculation_failure")
        .when(F.size("fired") > 0, F.get("fired", F.lit(0))["status"]).otherwise("qualified")
    )
    out = out.withColumn("fired", fired).withColumn("status", status)
    measured = ~F.col("status").isin("non_trading_day", "outside_premarket_session", "no_previous_close", "no_premarket_data", "calculation_failure")
    tier, direction = gap_tier(F.col("gap_pct")), gap_direction(F.col("gap_pct"))
    headline = F.when(F.col("catalyst_status").isin("earnings_today", "earnings_soon"), "; earnings date noted nearby.").when(
        F.col("catalyst_status") == "recent_headline", "; recent headline present."
    ).when(F.col("catalyst_status") == "earnings_and_recent_headline", "; earnings date and recent headline present.").otherwise(".")
    return out.withColumns(
        {
            "filter_reasons": F.when(measured, F.transform("fired", lambda x: x["reason"])),
            "gap_pct": F.when(measured, F.col("gap_pct")), "tier": F.when(measured, tier), "direction": F.when(measured, direction),
            "note": F.when(measured, F.concat(F.initcap(tier), F.lit(" "), direction, F.lit(" gap of "), F.format_string("%+.2f%%", "gap_pct"), headline)),
        }
    ).drop("fired", "opens_at")


def ranked_gaps(observations: DataFrame) -> DataFrame:
    return observations.filter("status = 'qualified'").orderBy(F.abs("gap_pct").desc(), "ticker", "session_date")


def status_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("status").agg(F.count(F.lit(1)).alias("observations"))
