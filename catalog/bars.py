"""Bars, calendar, quality, indicators and scores."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.config import CleaningPolicy
from barloom.operators import calendar as cal
from barloom.operators import quality as q
from barloom.operators.blocks import number_rows, owned
from barloom.operators.indicators import INDICATOR_COLUMNS, indicator_frame, with_indicators
from barloom.operators.ranks import expanding_rank, last_bar_rank
from barloom.operators.scores import SHORT_COMPONENTS, SIZE, add_long_score, add_score_inputs, add_short_score, latest_bar
from barloom.plans.screener import latest_scores
from barloom.session import settle
from barloom.sources import bars as src
from oracle.sql import DAILY, day, event_bars, indicators, minute, numbered, r, short_scores, with_

from .base import query, rnd, tidy

OHLCV = "open, high, low, close, volume"
R_OHLCV = ", ".join(f"{r(c)} AS {c}" for c in OHLCV.split(", "))


def faulty_bars(spark, sf):
    """Daily bars with deterministic faults of several kinds."""
    v = F.col("volume").cast("bigint")
    return src.daily_bars(spark, sf).select(
        "ticker", "ts",
        F.when(v % 47 == 1, 0.0).otherwise(F.col("open")).alias("open"),
        F.when(v % 41 == 3, F.col("low") * 0.9).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(v % 37 != 5, F.col("close")).alias("close"),
        F.when(v % 43 == 2, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
    )


FAULTY = """
fb AS MATERIALIZED (
  SELECT ticker, ts, CASE WHEN volume::BIGINT % 47 = 1 THEN 0e0 ELSE open END AS open,
    CASE WHEN volume::BIGINT % 41 = 3 THEN low * 0.9e0 ELSE high END AS high, low,
    CASE WHEN volume::BIGINT % 37 = 5 THEN NULL ELSE close END AS close,
    CASE WHEN volume::BIGINT % 43 = 2 THEN -volume ELSE volume END AS volume
  FROM bars),
coded AS MATERIALIZED (
  SELECT *, concat_ws('|',
    CASE WHEN close IS NULL THEN 'missing_or_non_numeric_close' END,
    CASE WHEN open <= 0 THEN 'nonpositive_open' END, CASE WHEN high <= 0 THEN 'nonpositive_high' END,
    CASE WHEN low <= 0 THEN 'nonpositive_low' END, CASE WHEN close <= 0 THEN 'nonpositive_close' END,
    CASE WHEN volume < 0 THEN 'negative_volume' END, CASE WHEN high < low THEN 'high_below_low' END,
    CASE WHEN high < open THEN 'high_below_open' END, CASE WHEN high < close THEN 'high_below_close' END,
    CASE WHEN low > open THEN 'low_above_open' END, CASE WHEN low > close THEN 'low_above_close' END) AS codes,
    row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS pos
  FROM fb)"""


@query("daily_bars", with_(DAILY, select=f"SELECT ticker, {day('ts')} AS ts, {R_OHLCV} FROM bars"))
def _(spark, sf):
    return tidy(src.daily_bars(spark, sf))


@query("event_bars_hourly", with_(event_bars(60), select=f"SELECT ticker, {minute('ts')} AS ts, {R_OHLCV} FROM bars"))
def _(spark, sf):
    return tidy(src.event_bars(spark, sf, 60), minutes=True)


WEEKLY = """
sess AS MATERIALIZED (
  SELECT d::DATE AS d, max(d::DATE) OVER (PARTITION BY date_trunc('week', d)) AS we
  FROM (SELECT unnest(generate_series((SELECT min(ts) FROM bars) - INTERVAL 7 DAY, (SELECT max(ts) FROM bars) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS d)
  WHERE isodow(d) < 6),
wk AS MATERIALIZED (
  SELECT ticker, we AS ts, first(open ORDER BY b.ts) AS open, max(high) AS high, min(low) AS low,
         last(close ORDER BY b.ts) AS close, sum(volume) AS volume, min(sd) AS first_session
  FROM (SELECT b.*, s.d AS sd, s.we FROM bars b ASOF JOIN sess s ON b.ts >= s.d) b
  GROUP BY ticker, we HAVING max(sd) = we)"""


def weekly(spark, sf):
    bars = src.daily_bars(spark, sf)
    return cal.weekly_bars(bars, cal.calendar_of(bars))


@query(
    "weekly_bars",
    with_(DAILY, WEEKLY, select=f"SELECT ticker, {day('ts')} AS ts, {R_OHLCV}, {day('first_session')} AS first_session FROM wk"),
)
def _(spark, sf):
    w = weekly(spark, sf)
    return tidy(w.select("ticker", F.col("week_end_session").alias("ts"), *OHLCV.split(", "), F.to_date("first_session_open_time").alias("first_session")))


@query("bar_reason_codes", with_(DAILY, FAULTY, select=f"SELECT ticker, {day('ts')} AS ts, codes AS reason_codes FROM coded WHERE codes <> ''"))
def _(spark, sf):
    flagged = q.flag_bars(faulty_bars(spark, sf)).filter(F.size("reason_codes") > 0)
    return tidy(flagged.select("ticker", "ts", "reason_codes"))


@query(
    "bar_first_fault",
    with_(DAILY, FAULTY, select="""
SELECT ticker, CASE WHEN close IS NULL THEN 'missing_or_non_numeric' WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'nonpositive_price'
  WHEN volume < 0 THEN 'negative_volume' WHEN high < low THEN 'high_below_low' WHEN high < open OR high < close THEN 'high_below_open_or_close'
  WHEN low > open OR low > close THEN 'low_above_open_or_close' ELSE 'none' END AS fault, count(*) AS rows
FROM fb GROUP BY 1, 2"""),
)
def _(spark, sf):
    checked = q.canonical_check(faulty_bars(spark, sf)).withColumn("fault", F.coalesce("fault", F.lit("none")))
    return checked.groupBy("ticker", "fault").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "response_rejection",
    with_(DAILY, FAULTY, select="""
SELECT ticker, month, count(*) AS kept FROM (
  SELECT *, strftime(ts, '%Y-%m') AS month, bool_and(codes = '') OVER (PARTITION BY ticker, strftime(ts, '%Y-%m')) AS good FROM coded)
WHERE good GROUP BY 1, 2"""),
)
def _(spark, sf):
    responses = faulty_bars(spark, sf).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return q.reject_responses(responses, ["ticker", "month"]).groupBy("ticker", "month").agg(F.count(F.lit(1)).alias("kept"))


RUNS = """
runs AS (
  SELECT ticker, island, min(pos) AS first_pos, count(*) AS length FROM (
    SELECT ticker, pos, sum((good)::INT) OVER (PARTITION BY ticker ORDER BY pos) AS island, good
    FROM (SELECT ticker, pos, codes = '' AS good FROM coded)) WHERE NOT good GROUP BY ticker, island)"""


@query("invalid_runs", with_(DAILY, FAULTY, RUNS, select="SELECT ticker, first_pos, length FROM runs"))
def _(spark, sf):
    runs = q.invalid_runs(number_rows(q.flag_bars(faulty_bars(spark, sf)), ["ticker"]))
    return runs.select("ticker", "first_pos", "length")


POLICY = CleaningPolicy(max_invalid_rows=210, max_invalid_rate_pct=14.0, max_consecutive=4, min_rows=100)
DEVELOPMENT = "1996-01-01"
CLEAN = f"""
tq AS MATERIALIZED (
  SELECT c.ticker, count(*) AS raw_rows, count(*) FILTER (codes <> '') AS invalid_rows, count(*) FILTER (codes = '') AS cleaned_rows,
    count(*) FILTER (codes = '' AND ts < TIMESTAMP '{DEVELOPMENT}') AS warmup_rows,
    bool_or(codes <> '' AND (pos = 0 OR pos = n - 1)) AS edge,
    coalesce((SELECT max(length) FROM runs WHERE runs.ticker = c.ticker), 0) AS longest_run
  FROM coded c JOIN (SELECT ticker, count(*) AS n FROM coded GROUP BY 1) t ON t.ticker = c.ticker GROUP BY c.ticker),
verdict AS MATERIALIZED (
  SELECT *, invalid_rows / raw_rows * 100e0 AS rate, concat_ws('|', CASE WHEN longest_run > 4 THEN 'consecutive' END,
    CASE WHEN edge THEN 'first_or_last_row' END, CASE WHEN invalid_rows > 210 THEN 'count' END,
    CASE WHEN invalid_rows / raw_rows * 100e0 > 14 THEN 'rate' END, CASE WHEN cleaned_rows = 0 THEN 'no_rows' END,
    CASE WHEN warmup_rows < 100 THEN 'warmup' END) AS failure_reasons FROM tq)"""


@query(
    "ticker_cleaning",
    with_(DAILY, FAULTY, RUNS, CLEAN, select=f"""
SELECT ticker, raw_rows, invalid_rows, cleaned_rows, warmup_rows, longest_run, {r('rate', 4)} AS invalid_rate_pct, failure_reasons,
  CASE WHEN failure_reasons = '' THEN 'pass' ELSE 'fail' END AS status FROM verdict"""),
)
def _(spark, sf):
    tq = q.ticker_quality(faulty_bars(spark, sf), POLICY, DEVELOPMENT)
    return tidy(tq.select("ticker", "raw_rows", "invalid_rows", "cleaned_rows", "warmup_rows", F.col("longest_run").cast("bigint").alias("longest_run"), "invalid_rate_pct", "failure_reasons", "status"))


@query(
    "cleaned_bar_counts",
    with_(DAILY, FAULTY, RUNS, CLEAN, select="SELECT ticker, count(*) AS rows FROM coded JOIN verdict USING (ticker) WHERE codes = '' AND failure_reasons = '' GROUP BY 1"),
)
def _(spark, sf):
    bars = faulty_bars(spark, sf)
    return q.cleaned_bars(bars, q.ticker_quality(bars, POLICY, DEVELOPMENT)).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "quality_audit",
    with_(DAILY, FAULTY, RUNS, CLEAN, select=f"""
SELECT count(*) AS symbols, sum(raw_rows)::BIGINT AS raw_rows, sum(cleaned_rows)::BIGINT AS cleaned_rows, sum(invalid_rows)::BIGINT AS invalid_rows,
  count(*) FILTER (invalid_rows > 0) AS affected_symbols, max(invalid_rows) AS max_invalid_rows, {r('max(rate)')} AS max_invalid_rate_pct,
  max(longest_run) AS max_run, count(*) FILTER (failure_reasons = '') AS passing_symbols,
  {r('sum(invalid_rows) / sum(raw_rows) * 100e0')} AS total_rate_pct FROM verdict"""),
)
def _(spark, sf):
    return tidy(q.quality_audit(q.ticker_quality(faulty_bars(spark, sf), POLICY, DEVELOPMENT)))


@query(
    "invalid_reason_counts",
    with_(DAILY, FAULTY, select="SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(codes, '|')) AS reason FROM coded WHERE codes <> '') GROUP BY 1"),
)
def _(spark, sf):
    return q.reason_counts(q.flag_bars(faulty_bars(spark, sf)))


@query(
    "weekly_study_check",
    with_(DAILY, FAULTY, select="""
SELECT ticker, sum(n)::BIGINT AS rows, count(*) AS unique_rows, sum(n - 1)::BIGINT AS duplicate_timestamps,
  count(*) FILTER (close IS NULL) AS missing_required_values,
  count(*) FILTER (close IS NOT NULL AND bad) AS invalid_ohlc_rows, count(*) FILTER (close IS NOT NULL AND NOT bad) AS valid_rows
FROM (SELECT ticker, date_trunc('week', ts) AS w, count(*) AS n, arg_min(close IS NULL, ts) AS cn,
        first(close ORDER BY ts) AS close,
        first(high < low OR close > high OR close < low OR open > high OR open < low ORDER BY ts) AS bad
      FROM fb GROUP BY 1, 2) GROUP BY ticker"""),
)
def _(spark, sf):
    # every day of a week stamped with the week start: duplicates of which the first is kept
    bars = faulty_bars(spark, sf).withColumn("arrival", F.unix_seconds("ts")).withColumn("ts", F.date_trunc("week", "ts"))
    _, counts = q.weekly_study_check(bars, "arrival")
    return counts.select("ticker", "rows", "unique_rows", "duplicate_timestamps", "missing_required_values", "invalid_ohlc_rows", "valid_rows")


@query(
    "invalid_ohlc_counts",
    with_(DAILY, FAULTY, select="SELECT ticker, count(*) FILTER (close IS NULL OR high < low OR high < greatest(open, close) OR low > least(open, close)) AS invalid_rows FROM fb GROUP BY 1"),
)
def _(spark, sf):
    return faulty_bars(spark, sf).groupBy("ticker").agg(F.count_if(q.invalid_ohlc()).alias("invalid_rows"))


IND_DIGITS = {"rsi": 4, "macd": 3, "macd_signal": 3, "macd_diff": 3, "ema_20": 3, "ema_50": 3, "bb_upper": 3, "bb_lower": 3, "bb_width": 3, "atr": 3, "volume_sma20": 4, "volume_ratio": 4}
IND_SQL = ", ".join(f"{r(c, d)} AS {c}" for c, d in IND_DIGITS.items())


def _ind(df):
    return df.select("ticker", "ts", "pos", *[rnd(c, d).alias(c) for c, d in IND_DIGITS.items()])


@query("indicators_daily", with_(DAILY, numbered(), indicators(), select=f"SELECT ticker, {day('ts')} AS ts, pos, {IND_SQL} FROM ind"))
def _(spark, sf):
    return tidy(_ind(indicator_frame(src.daily_bars(spark, sf))), 6)


@query("indicators_five_minute", with_(event_bars(5), numbered(), indicators(), select=f"SELECT ticker, {minute('ts')} AS ts, pos, {IND_SQL} FROM ind"))
def _(spark, sf):
    return tidy(_ind(indicator_frame(src.event_bars(spark, sf, 5))), 6, minutes=True)


FLAGS = ", ".join(SHORT_COMPONENTS)


@query(
    "short_score_every_bar",
    with_(DAILY, numbered(), indicators(), short_scores(), select=f"SELECT ticker, {day('ts')} AS ts, {FLAGS}, score::BIGINT AS score FROM sc"),
)
def _(spark, sf):
    scored = add_short_score(owned(with_indicators(src.daily_bars(spark, sf))))
    return tidy(scored.select("ticker", "ts", *SHORT_COMPONENTS, "score"))


def short_ranked(spark, sf):
    """Validated daily bars, indicators and the short score of the last bar, best first."""
    bars = src.daily_bars(spark, sf).filter(F.size(q.reason_codes()) == 0)
    last = latest_bar(owned(with_indicators(bars, size=SIZE)))
    scored = add_short_score(last)
    return tidy(scored.select("ticker", "ts", "score", "close", "volume_ratio", "rsi", *SHORT_COMPONENTS), 3).orderBy(F.desc("score"), "ticker")


@query(
    "short_score_ranked",
    with_(DAILY, numbered(), indicators(), short_scores(), select=f"""
SELECT ticker, {day('ts')} AS ts, score::BIGINT AS score, {r('close', 3)} AS close, {r('volume_ratio', 3)} AS volume_ratio, {r('rsi', 3)} AS rsi, {FLAGS}
FROM sc QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) = 1 ORDER BY score DESC, ticker"""),
)
def _(spark, sf):
    return short_ranked(spark, sf)


def recent(src_name, rows, out):
    return f"""
{out} AS MATERIALIZED (
  SELECT * FROM {src_name} QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) <= {rows})"""


LAST_RANK = """
lr AS (
  SELECT i.*, lag(macd_diff) OVER (PARTITION BY ticker ORDER BY pos) AS pd, avg(volume_ratio) OVER (PARTITION BY ticker ORDER BY pos ROWS 7 PRECEDING) AS vr8,
    (rank() OVER (PARTITION BY ticker ORDER BY bb_width NULLS LAST) + (count(*) OVER (PARTITION BY ticker, bb_width) - 1) / 2e0)
      / count(bb_width) OVER (PARTITION BY ticker) AS wr
  FROM ind i),
lst AS (SELECT * FROM lr QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pos DESC) = 1)"""

INTRADAY_SCORE = """
least(100, CASE WHEN volume_ratio >= 2 THEN 30 WHEN volume_ratio >= 1.5 THEN 15 ELSE 0 END + CASE WHEN wr > 0.8 THEN 20 ELSE 0 END
  + CASE WHEN rsi BETWEEN 55 AND 75 THEN 20 WHEN rsi BETWEEN 25 AND 45 THEN 15 ELSE 0 END
  + CASE WHEN macd_diff > 0 AND pd <= 0 THEN 30 ELSE 0 END)::BIGINT"""
LONG_SCORE = """
least(100, CASE WHEN close > ema_50 THEN 25 ELSE 0 END + CASE WHEN rsi BETWEEN 40 AND 65 THEN 20 ELSE 0 END
  + CASE WHEN vr8 >= 1.15 THEN 25 ELSE 0 END + CASE WHEN macd > macd_signal THEN 15 ELSE 0 END + CASE WHEN wr < 0.25 THEN 15 ELSE 0 END)::BIGINT"""


@query(
    "intraday_score_latest",
    with_(event_bars(60, "allb"), recent("allb", 390, "bars"), numbered(), indicators(), LAST_RANK, select=f"""
SELECT ticker, {minute('ts')} AS ts, pos + 1 AS bar_count, {INTRADAY_SCORE} AS score, {r('close', 3)} AS close, {r('volume_ratio', 3)} AS volume_ratio,
  {r('rsi', 3)} AS rsi, {r('wr')} AS bb_width_rank FROM lst"""),
)
def _(spark, sf):
    s = latest_scores(src.event_bars(spark, sf, 60), "intraday")
    return tidy(s.select("ticker", "ts", "bar_count", "score", rnd("close", 3).alias("close"), rnd("volume_ratio", 3).alias("volume_ratio"), rnd("rsi", 3).alias("rsi"), "bb_width_rank"), minutes=True)


@query(
    "long_score_latest",
    with_(DAILY, WEEKLY, recent("wk", 104, "wr104"), numbered("wr104"), indicators(), LAST_RANK, select=f"""
SELECT ticker, {day('ts')} AS ts, pos + 1 AS bar_count, {LONG_SCORE} AS score, {r('close', 3)} AS close, {r('vr8', 3)} AS volume_ratio_8,
  {r('rsi', 3)} AS rsi, {r('wr')} AS bb_width_rank FROM lst"""),
)
def _(spark, sf):
    s = latest_scores(weekly(spark, sf), "long")
    return tidy(s.select("ticker", "ts", "bar_count", "score", rnd("close", 3).alias("close"), rnd("volume_ratio_8", 3).alias("volume_ratio_8"), rnd("rsi", 3).alias("rsi"), "bb_width_rank"))


EXPANDING = """
lr AS MATERIALIZED (
  SELECT i.*, avg(volume_ratio) OVER (PARTITION BY ticker ORDER BY pos ROWS 7 PRECEDING) AS vr8,
    CASE WHEN bb_width IS NOT NULL THEN
    ((SELECT count(*) FROM ind j WHERE j.ticker = i.ticker AND j.pos <= i.pos AND j.bb_width < i.bb_width)
     + ((SELECT count(*) FROM ind j WHERE j.ticker = i.ticker AND j.pos <= i.pos AND j.bb_width = i.bb_width) + 1) / 2e0)
    / (SELECT count(bb_width) FROM ind j WHERE j.ticker = i.ticker AND j.pos <= i.pos) END AS wr
  FROM ind i)"""


def weekly_scored(spark, sf):
    """Long score at every weekly bar, its band width ranked among the whole past."""
    rows = settle(owned(add_score_inputs(with_indicators(weekly(spark, sf)))))
    return add_long_score(expanding_rank(rows, ["ticker"], "bb_width"))


@query(
    "long_score_every_week",
    with_(DAILY, WEEKLY, numbered("wk"), indicators(), EXPANDING, select=f"SELECT ticker, {day('ts')} AS ts, {LONG_SCORE} AS score, {r('wr')} AS bb_width_rank FROM lr"),
)
def _(spark, sf):
    return tidy(weekly_scored(spark, sf).select("ticker", "ts", "score", "bb_width_rank"))


@query(
    "width_percent_rank",
    with_(DAILY, numbered(), indicators(), LAST_RANK, select=f"SELECT ticker, {r('wr', 6)} AS bb_width_rank FROM lst"),
)
def _(spark, sf):
    return tidy(last_bar_rank(indicator_frame(src.daily_bars(spark, sf)), ["ticker"], "bb_width"), 6)
