"""Session calendar as a dimension table, and what is derived from it.

A calendar has one row per session: a few hundred per year of history, whatever the number of bars.
Windows over it and broadcasts of it are bounded by the calendar span.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = "America/New_York"


def local_day(ts: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def local_minute(ts: Column | str) -> Column:
    t = F.from_utc_timestamp(ts, ZONE)
    return F.hour(t) * 60 + F.minute(t)


def at_local(day: Column, minute: Column | int) -> Column:
    minute = F.lit(minute) if isinstance(minute, int) else minute
    local = F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + minute * 60)
    return F.to_utc_timestamp(local, ZONE)


def days_between(bounds: DataFrame) -> DataFrame:
    """One row per day of a one-row (first_day, last_day) table."""
    return bounds.select(F.explode(F.sequence("first_day", "last_day")).alias("session_date"))


def sessions_from_days(
    days: DataFrame, trading: Column | None = None, early_close: Column | None = None,
    open_minute: int = 570, close_minute: int = 960, early_minute: int = 780,
) -> DataFrame:
    """Sessions of a day list: ``trading`` says which days trade (default Monday to Friday)."""
    if trading is None:
        trading = F.weekday("session_date") < 5
    early = F.lit(False) if early_close is None else early_close
    week = F.date_trunc("week", "session_date")
    number = Window.orderBy("session_date")
    return (
        days.filter(trading)
        .withColumn("session_no", F.row_number().over(number))
        .withColumn("week_end_session", F.max("session_date").over(Window.partitionBy(week)))
        .withColumn("is_early_close", early)
        .withColumn("opens_at", at_local(F.col("session_date"), open_minute))
        .withColumn(
            "closes_at",
            at_local(F.col("session_date"), F.when(F.col("is_early_close"), early_minute).otherwise(close_minute)),
        )
    )


def calendar_of(bars: DataFrame, ts: str = "ts", pad_days: int = 7, **rules) -> DataFrame:
    """Calendar covering the time span of a bar table (min and max combine map-side)."""
    bounds = bars.agg(
        F.date_sub(F.to_date(F.min(ts)), pad_days).alias("first_day"),
        F.date_add(F.to_date(F.max(ts)), pad_days).alias("last_day"),
    )
    return sessions_from_days(days_between(bounds), **rules)


def day_facts(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every day with: is it a session, the session on or before it, the previous and the next session."""
    s = sessions.select("session_date", F.lit(True).alias("is_session"))
    back = Window.orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("session_date").rowsBetween(1, Window.unboundedFollowing)
    day = F.when(F.col("is_session"), F.col("session_date"))
    joined = days.join(s, "session_date", "left").withColumn("is_session", F.coalesce("is_session", F.lit(False)))
    return (
        joined.withColumn("previous_session", F.max(day).over(back))
        .withColumn("next_session", F.min(day).over(onward))
        .withColumn("session_on_or_before", F.when(F.col("is_session"), F.col("session_date")).otherwise(F.col("previous_session")))
    )


def session_grid(sessions: DataFrame, bar_minutes: int = 5, keep_early: bool = False) -> DataFrame:
    """Expected bar starts of each full session with their 0-based index."""
    full = sessions if keep_early else sessions.filter(~F.col("is_early_close"))
    step = F.expr(f"INTERVAL {bar_minutes} MINUTES")
    starts = F.sequence(F.col("opens_at"), F.col("closes_at") - step, step)
    return full.select("session_date", "session_no", F.posexplode(starts).alias("grid_idx", "bar_start"))


# Texts of the four market states.
MARKET_STATES = {
    "holiday": "Weekend or exchange holiday",
    "before": "Before regular session",
    "open": "Regular session open",
    "after": "After regular session",
}


def market_status(instants: DataFrame, sessions: DataFrame, ts: str = "ts") -> DataFrame:
    """Market state at each instant, with the next open where the market is shut."""
    facts = day_facts(daily_span_of(sessions), sessions)
    opens = sessions.select(F.col("session_date").alias("next_session"), F.col("opens_at").alias("following_open"))
    days = (
        facts.join(opens, "next_session", "left")
        .join(sessions.select("session_date", "opens_at", "closes_at"), "session_date", "left")
        .select("session_date", "is_session", "opens_at", "closes_at", "following_open")
    )
    t = F.col(ts)
    state = (
        F.when(~F.col("is_session"), MARKET_STATES["holiday"])
        .when(t < F.col("opens_at"), MARKET_STATES["before"])
        .when(t < F.col("closes_at"), MARKET_STATES["open"])
        .otherwise(MARKET_STATES["after"])
    )
    next_open = (
        F.when(F.col("is_session") & (t < F.col("opens_at")), F.col("opens_at"))
        .when(F.col("is_session") & (t < F.col("closes_at")), F.lit(None).cast("timestamp"))
        .otherwise(F.col("following_open"))
    )
    return (
        instants.withColumn("session_date", local_day(ts))
        .join(F.broadcast(days), "session_date")
        .withColumn("reason", state)
        .withColumn("is_open", state == MARKET_STATES["open"])
        .withColumn("next_open", next_open)
        .drop("opens_at", "closes_at", "following_open")
    )


def daily_span_of(sessions: DataFrame) -> DataFrame:
    return days_between(sessions.agg(F.min("session_date").alias("first_day"), F.max("session_date").alias("last_day")))


def prior_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """Pairs (session_date, prior_date) of every session with its n predecessors."""
    a = sessions.select("session_date", "session_no")
    b = sessions.select(F.col("session_date").alias("prior_date"), F.col("session_no").alias("prior_no"))
    offsets = a.withColumn("prior_no", F.explode(F.sequence(F.col("session_no") - n, F.col("session_no") - 1)))
    return offsets.join(b, "prior_no").select("session_date", "prior_date", (F.col("session_no") - F.col("prior_no")).alias("back"))


def business_days_between(start: Column, end: Column) -> Column:
    """Monday-to-Friday days from ``start`` to ``end``, both included (holidays are not looked at)."""
    def ordinal(d: Column) -> Column:
        days = F.datediff(d, F.lit("1970-01-05").cast("date"))
        return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4))
    weekend_start = F.weekday(start) >= 5
    return ordinal(end) - ordinal(start) + F.when(weekend_start, 0).otherwise(1)


def is_stale(last_bar: Column, as_of: Column, limit: int = 2) -> Column:
    return business_days_between(F.to_date(last_bar), F.to_date(as_of)) > limit


def in_split(day: Column, splits) -> Column:
    """Name of the split holding a day; NULL outside every split."""
    out = None
    for s in splits:
        hit = day.between(F.lit(s.start).cast("date"), F.lit(s.end).cast("date"))
        out = F.when(hit, s.name) if out is None else out.when(hit, s.name)
    return out


def split_for_month(month: Column, splits) -> Column:
    """Split whose date range overlaps the month of ``month`` (first match in order)."""
    first, last = F.trunc(month, "month"), F.last_day(month)
    out = None
    for s in splits:
        hit = (first <= F.lit(s.end).cast("date")) & (last >= F.lit(s.start).cast("date"))
        out = F.when(hit, s.name) if out is None else out.when(hit, s.name)
    return out.otherwise("out_of_range")


def weekly_bars(daily: DataFrame, sessions: DataFrame) -> DataFrame:
    """Daily bars to weekly bars of real sessions.

    A bar on a non-session day belongs to the session before it. A week counts only when a bar of
    its last session is present.
    """
    days = day_facts(daily_span(daily), sessions).select(F.col("session_date").alias("day"), "session_on_or_before")
    on_session = (
        daily.withColumn("day", F.to_date("ts"))
        .join(F.broadcast(days), "day")
        .filter(F.col("session_on_or_before").isNotNull())
        .join(
            F.broadcast(sessions.select("session_date", "week_end_session", "opens_at", "closes_at")),
            F.col("session_on_or_before") == F.col("session_date"),
        )
    )
    at = F.unix_micros("ts")
    weeks = on_session.groupBy("ticker", "week_end_session").agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"),
        F.min("opens_at").alias("first_session_open_time"),
        F.max("session_date").alias("last_present"), F.max("closes_at").alias("ts"),
    )
    return weeks.filter(F.col("last_present") == F.col("week_end_session")).drop("last_present")


def daily_span(bars: DataFrame, ts: str = "ts", pad_days: int = 7) -> DataFrame:
    bounds = bars.agg(
        F.date_sub(F.to_date(F.min(ts)), pad_days).alias("first_day"),
        F.date_add(F.to_date(F.max(ts)), pad_days).alias("last_day"),
    )
    return days_between(bounds)
