"""The three scorers as column expressions over indicator columns.

A comparison with a missing value counts as false, so every condition is wrapped by ``_met``.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IntradayWeights, LongWeights, ShortWeights
from .blocks import block_window, number_rows

SHORT_COMPONENTS = ["ema_structure", "volume_confirmation", "rsi_momentum", "macd_positive", "pullback_ema"]


def _met(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _capped(points: list[Column]) -> Column:
    return F.least(sum(points, F.lit(0)), F.lit(100)).cast("int")


def _text(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def short_flags() -> dict[str, Column]:
    c, e20, e50 = F.col("close"), F.col("ema_20"), F.col("ema_50")
    return {
        "ema_structure": _met((c > e20) & (e20 > e50)),
        "volume_confirmation": _met(F.col("volume_ratio") >= 1.3),
        "rsi_momentum": _met(F.col("rsi").between(50, 70)),
        "macd_positive": _met((F.col("macd") > 0) & (F.col("macd_diff") > 0)),
        "pullback_ema": _met((F.try_divide(F.abs(c - e20), e20) < 0.015) & (e20 > e50)),
    }


def add_short_score(df: DataFrame, weights: ShortWeights = ShortWeights()) -> DataFrame:
    """Component flags, points, raw score, capped score and reasons at every bar."""
    df = df.withColumns(short_flags())
    points = {f"points_{n}": F.when(F.col(n), getattr(weights, n)).otherwise(0) for n in SHORT_COMPONENTS}
    df = df.withColumns(points)
    raw = sum((F.col(p) for p in points), F.lit(0))
    # Reason texts of the short score.
    reasons = _text(
        F.when(F.col("ema_structure"), "Price above EMA20 > EMA50 — bullish structure"),
        F.when(F.col("volume_confirmation"), F.format_string("Volume confirming move (%.1fx avg)", "volume_ratio")),
        F.when(F.col("rsi_momentum"), F.format_string("RSI in momentum zone (%.0f)", "rsi")),
        F.when(F.col("macd_positive"), "MACD positive and expanding"),
        F.when(F.col("pullback_ema"), "Pullback to EMA20 in uptrend — entry opportunity"),
    )
    return df.withColumns({"raw_score": raw, "score": F.least(raw, F.lit(100)).cast("int"), "reasons": reasons})


def intraday_points(weights: IntradayWeights = IntradayWeights()) -> dict[str, Column]:
    """Points per component; needs ``previous_diff`` (histogram one bar earlier) and ``bb_width_rank``."""
    vr, rsi = F.col("volume_ratio"), F.col("rsi")
    return {
        "points_volume_surge": F.when(_met(vr >= 2.0), weights.volume_surge)
        .when(_met(vr >= 1.5), weights.volume_surge // 2).otherwise(0),
        "points_bb_expansion": F.when(_met(F.col("bb_width_rank") > 0.8), weights.bb_expansion).otherwise(0),
        "points_rsi_momentum": F.when(_met(rsi.between(55, 75)), weights.rsi_momentum)
        .when(_met(rsi.between(25, 45)), round(weights.rsi_momentum * 0.75)).otherwise(0),
        "points_macd_crossover": F.when(_met((F.col("macd_diff") > 0) & (F.col("previous_diff") <= 0)), weights.macd_crossover).otherwise(0),
    }


def add_intraday_score(df: DataFrame, weights: IntradayWeights = IntradayWeights()) -> DataFrame:
    points = intraday_points(weights)
    df = df.withColumns(points)
    # Reason texts of the intraday score.
    reasons = _text(
        F.when(F.col("points_volume_surge") == weights.volume_surge, F.format_string("Volume surge %.1fx avg", "volume_ratio"))
        .when(F.col("points_volume_surge") > 0, F.format_string("Elevated volume %.1fx avg", "volume_ratio")),
        F.when(F.col("points_bb_expansion") > 0, "BB expanding after squeeze — volatility breakout"),
        F.when(F.col("points_rsi_momentum") == weights.rsi_momentum, F.format_string("RSI bullish momentum (%.0f)", "rsi"))
        .when(F.col("points_rsi_momentum") > 0, F.format_string("RSI oversold bounce setup (%.0f)", "rsi")),
        F.when(F.col("points_macd_crossover") > 0, "MACD bullish crossover"),
    )
    return df.withColumns({"score": _capped([F.col(p) for p in points]), "reasons": reasons})


def long_points(weights: LongWeights = LongWeights()) -> dict[str, Column]:
    """Points per component; needs ``volume_ratio_8`` and ``bb_width_rank``."""
    return {
        "points_secular_uptrend": F.when(_met(F.col("close") > F.col("ema_50")), weights.secular_uptrend).otherwise(0),
        "points_rsi_healthy": F.when(_met(F.col("rsi").between(40, 65)), weights.rsi_healthy).otherwise(0),
        "points_volume_accumulation": F.when(_met(F.col("volume_ratio_8") >= 1.15), weights.volume_accumulation).otherwise(0),
        "points_macd_bullish": F.when(_met(F.col("macd") > F.col("macd_signal")), weights.macd_bullish).otherwise(0),
        "points_bb_coil": F.when(_met(F.col("bb_width_rank") < 0.25), weights.bb_coil).otherwise(0),
    }


def add_long_score(df: DataFrame, weights: LongWeights = LongWeights()) -> DataFrame:
    points = long_points(weights)
    df = df.withColumns(points)
    # Reason texts of the long score.
    reasons = _text(
        F.when(F.col("points_secular_uptrend") > 0, "Price above long-term EMA50 — secular uptrend"),
        F.when(F.col("points_rsi_healthy") > 0, F.format_string("RSI healthy, not overbought (%.0f)", "rsi")),
        F.when(F.col("points_volume_accumulation") > 0, F.format_string("8-period volume accumulation (%.2fx avg)", "volume_ratio_8")),
        F.when(F.col("points_macd_bullish") > 0, "MACD above signal on weekly — bullish bias"),
        F.when(F.col("points_bb_coil") > 0, "Tight BB on weekly — coiling for breakout"),
    )
    return df.withColumns({"score": _capped([F.col(p) for p in points]), "reasons": reasons})


def add_score_inputs(df: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Previous histogram and 8-bar mean volume ratio."""
    w = block_window(keys)
    return df.withColumns(
        {
            "previous_diff": F.lag("macd_diff").over(w),
            "volume_ratio_8": F.avg("volume_ratio").over(w.rowsBetween(-7, 0)),
        }
    )


SIZE = "series_rows"


def latest_bar(sized: DataFrame) -> DataFrame:
    """The last row of every series of a frame numbered with its size: a filter, no aggregate."""
    return sized.filter(F.col("pos") == F.col(SIZE) - 1)


def recent_bars(bars: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The last ``rows`` bars of every series, renumbered from 0: the bounded frame a latest-bar scorer sees."""
    numbered = number_rows(bars, keys, size=SIZE)
    skip = F.greatest(F.col(SIZE) - rows, F.lit(0))
    return numbered.filter(F.col("pos") >= skip).withColumns({"pos": F.col("pos") - skip, SIZE: F.least(F.col(SIZE), F.lit(rows))})
