"""Bar quality: reason codes, runs of bad rows, cleaning verdicts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CleaningPolicy
from .blocks import number_rows

PRICES = ["open", "high", "low", "close"]
FIELDS = PRICES + ["volume"]
# Reason codes of the cross-field checks, in report order.
ENVELOPE = [
    ("high_below_low", "high", "low"),
    ("high_below_open", "high", "open"),
    ("high_below_close", "high", "close"),
    ("low_above_open", "open", "low"),
    ("low_above_close", "close", "low"),
]


def _finite(c: str) -> Column:
    x = F.col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def _missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c)


def reason_codes() -> Column:
    """All broken rules of a row as an array, in the fixed order of the twenty codes."""
    checks = [F.when(_missing(c), f"missing_or_non_numeric_{c}") for c in FIELDS]
    checks += [F.when(~_missing(c) & ~_finite(c), f"non_finite_{c}") for c in FIELDS]
    checks += [F.when(_finite(c) & (F.col(c) <= 0), f"nonpositive_{c}") for c in PRICES]
    checks.append(F.when(_finite("volume") & (F.col("volume") < 0), "negative_volume"))
    checks += [F.when(_finite(a) & _finite(b) & (F.col(a) < F.col(b)), name) for name, a, b in ENVELOPE]
    return F.array_compact(F.array(*checks))


def flag_bars(bars: DataFrame) -> DataFrame:
    return bars.withColumn("reason_codes", reason_codes())


def first_fault() -> Column:
    """The first broken invariant of canonical bars, in the order a strict reader would stop at."""
    numbers = [F.col(c) for c in PRICES]
    any_of = lambda conds: F.greatest(*[c.cast("int") for c in conds]) == 1
    return (
        F.when(any_of([~_missing(c) & ~_finite(c) for c in FIELDS]), "non_finite")
        .when(any_of([_missing(c) for c in FIELDS]), "missing_or_non_numeric")
        .when(F.least(*numbers) <= 0, "nonpositive_price")
        .when(F.col("volume") < 0, "negative_volume")
        .when(F.col("high") < F.col("low"), "high_below_low")
        .when(F.col("high") < F.greatest("open", "close"), "high_below_open_or_close")
        .when(F.col("low") > F.least("open", "close"), "low_above_open_or_close")
    )


def canonical_check(bars: DataFrame) -> DataFrame:
    """First broken invariant and the number of rows at the same (ticker, ts); empty verdict = canonical."""
    n = bars.groupBy("ticker", "ts").agg(F.count(F.lit(1)).alias("copies"))
    flagged = bars.withColumn("fault", first_fault())
    return flagged.join(n, ["ticker", "ts"]).withColumn(
        "fault", F.coalesce(F.when(F.col("copies") > 1, "duplicate_timestamp"), F.col("fault"))
    )


def reject_responses(bars: DataFrame, response: list[str]) -> DataFrame:
    """Keep only bars of responses without a single bad row."""
    bad = bars.filter(F.size(reason_codes()) > 0).select(*response).distinct()
    return bars.join(bad, response, "left_anti")


def invalid_runs(numbered: DataFrame) -> DataFrame:
    """Runs of consecutive invalid rows per ticker: (ticker, first_pos, length). Needs ``pos`` and ``reason_codes``."""
    bad = numbered.filter(F.size("reason_codes") > 0).select("ticker", "ts", F.col("pos").alias("at"))
    ranked = number_rows(bad, ["ticker"], "ts")
    return ranked.groupBy("ticker", (F.col("at") - F.col("pos")).alias("island")).agg(
        F.min("at").alias("first_pos"), F.count(F.lit(1)).alias("length")
    )


def ticker_quality(bars: DataFrame, policy: CleaningPolicy, development_start: str) -> DataFrame:
    """Counts, limits and verdict per ticker; rows are dropped by the caller, never repaired."""
    flagged = number_rows(flag_bars(bars), ["ticker"], "ts")
    bad = F.size("reason_codes") > 0
    facts = flagged.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(bad).alias("invalid_rows"),
        F.min_by(bad, "pos").alias("first_bad"),
        F.max_by(bad, "pos").alias("last_bad"),
        F.count_if(~bad & (F.col("ts") < F.lit(development_start).cast("timestamp"))).alias("warmup_rows"),
    )
    runs = invalid_runs(flagged).groupBy("ticker").agg(F.max("length").alias("longest_run"))
    joined = facts.join(runs, "ticker", "left").withColumns(
        {
            "longest_run": F.coalesce("longest_run", F.lit(0)),
            "cleaned_rows": F.col("raw_rows") - F.col("invalid_rows"),
            "invalid_rate_pct": F.col("invalid_rows") / F.col("raw_rows") * 100.0,
        }
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("longest_run") > policy.max_consecutive, "consecutive"),
            F.when(F.col("first_bad") | F.col("last_bad"), "first_or_last_row"),
            F.when(F.col("invalid_rows") > policy.max_invalid_rows, "count"),
            F.when(F.col("invalid_rows") / F.col("raw_rows") * 100.0 > policy.max_invalid_rate_pct, "rate"),
            F.when(F.col("cleaned_rows") == 0, "no_rows"),
            F.when(F.col("warmup_rows") < policy.min_rows, "warmup"),
        )
    )
    return joined.withColumn("failure_reasons", reasons).withColumn(
        "status", F.when(F.size("failure_reasons") == 0, "pass").otherwise("fail")
    )


def cleaned_bars(bars: DataFrame, quality: DataFrame) -> DataFrame:
    """Valid rows of passing tickers."""
    passing = quality.filter("status = 'pass'").select("ticker")
    return bars.filter(F.size(reason_codes()) == 0).join(passing, "ticker", "left_semi")


def quality_audit(quality: DataFrame) -> DataFrame:
    """Totals and maxima over all tickers."""
    return quality.agg(
        F.count(F.lit(1)).alias("symbols"),
        F.sum("raw_rows").alias("raw_rows"),
        F.sum("cleaned_rows").alias("cleaned_rows"),
        F.sum("invalid_rows").alias("invalid_rows"),
        F.count_if(F.col("invalid_rows") > 0).alias("affected_symbols"),
        F.max("invalid_rows").alias("max_invalid_rows"),
        F.max("invalid_rate_pct").alias("max_invalid_rate_pct"),
        F.max("longest_run").alias("max_run"),
        F.count_if(F.col("status") == "pass").alias("passing_symbols"),
    ).withColumn("total_rate_pct", F.col("invalid_rows") / F.col("raw_rows") * 100.0)


def reason_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("reason_codes").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def weekly_study_check(bars: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Keep the first duplicate, drop rows with missing values or a broken envelope; (clean bars, counts)."""
    from ..sources.bars import keep_one

    first = keep_one(bars, ["ticker", "ts"], order, last=False)
    missing = F.greatest(*[_missing(c).cast("int") for c in FIELDS]) == 1
    broken = (F.col("high") < F.greatest("low", "open", "close")) | (F.col("low") > F.least("open", "close"))
    clean = first.filter(~missing & ~broken)
    dup = bars.groupBy("ticker").agg((F.count(F.lit(1))).alias("rows"))
    counts = first.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("unique_rows"),
        F.sum(sum((_missing(c).cast("int") for c in FIELDS), F.lit(0))).alias("missing_required_values"),
        F.count_if(~missing & broken).alias("invalid_ohlc_rows"),
        F.count_if(~missing & ~broken).alias("valid_rows"),
    )
    return clean, counts.join(dup, "ticker").withColumn("duplicate_timestamps", F.col("rows") - F.col("unique_rows"))


def invalid_ohlc() -> Column:
    """True for a missing number or a broken high/low envelope."""
    missing = F.greatest(*[_missing(c).cast("int") for c in FIELDS]) == 1
    return missing | (F.col("high") < F.greatest("low", "open", "close")) | (F.col("low") > F.least("open", "close"))
