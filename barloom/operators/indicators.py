"""Technical indicators over blocked bars (one exchange, shared windows)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_ROWS, HALO_ROWS, block_window, lay_out, owned, smooth

INDICATOR_COLUMNS = [
    "rsi", "macd", "macd_signal", "macd_diff", "ema_20", "ema_50",
    "bb_upper", "bb_lower", "bb_width", "atr", "volume_sma20", "volume_ratio",
]


def ema_input(value, alpha: float, first: int):
    """Smoothing input of an exponential average seeded with the value at position ``first``."""
    return (
        F.when(F.col("pos") == first, value)
        .when(F.col("pos") > first, value * F.lit(alpha))
        .otherwise(F.lit(0.0))
    )


def add_indicators_to_blocks(df: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Add the twelve indicator columns to bars already laid out with ``before >= HALO_ROWS``."""
    w = block_window(keys)
    full20 = w.rowsBetween(-19, 0)
    pos = F.col("pos")
    df = df.withColumns(
        {
            "prev_close": F.lag("close").over(w),
            "_mid": F.avg("close").over(full20),
            "_dev": F.stddev_pop("close").over(full20),
            "volume_sma20": F.when(pos >= 19, F.avg("volume").over(full20)),
        }
    )
    move = F.col("close") - F.col("prev_close")
    df = df.withColumns(
        {
            "_up": F.coalesce(F.greatest(move, F.lit(0.0)), F.lit(0.0)),
            "_dn": F.coalesce(F.greatest(-move, F.lit(0.0)), F.lit(0.0)),
            "_tr": F.greatest(
                F.col("high") - F.col("low"),
                F.abs(F.col("high") - F.col("prev_close")),
                F.abs(F.col("low") - F.col("prev_close")),
            ),
        }
    )
    df = df.withColumn("_tr14", F.avg("_tr").over(w.rowsBetween(-13, 0)))
    wilder = 1.0 / 14.0
    close = F.col("close")
    spans = {"_e12": 12, "_e26": 26, "_e20": 20, "_e50": 50}
    specs = {n: (ema_input(close, 2.0 / (s + 1), 0), 2.0 / (s + 1)) for n, s in spans.items()}
    specs["_gain"] = (ema_input(F.col("_up"), wilder, 0), wilder)
    specs["_loss"] = (ema_input(F.col("_dn"), wilder, 0), wilder)
    specs["_atr"] = (
        F.when(pos < 13, F.lit(0.0)).when(pos == 13, F.col("_tr14")).otherwise(F.col("_tr") * F.lit(wilder)),
        wilder,
    )
    df = smooth(df, keys, specs)
    macd = F.when(pos >= 25, F.col("_e12") - F.col("_e26"))
    df = df.withColumn("macd", macd)
    signal_alpha = 2.0 / 10.0
    df = smooth(df, keys, {"_signal": (ema_input(F.col("macd"), signal_alpha, 25), signal_alpha)})
    upper = F.col("_mid") + 2 * F.col("_dev")
    lower = F.col("_mid") - 2 * F.col("_dev")
    has20 = pos >= 19
    df = df.withColumns(
        {
            "rsi": F.when(
                pos >= 13,
                F.when(F.col("_loss") == 0, F.lit(100.0)).otherwise(
                    100.0 - 100.0 / (1.0 + F.try_divide(F.col("_gain"), F.col("_loss")))
                ),
            ),
            "macd_signal": F.when(pos >= 33, F.col("_signal")),
            "ema_20": F.when(pos >= 19, F.col("_e20")),
            "ema_50": F.when(pos >= 49, F.col("_e50")),
            "bb_upper": F.when(has20, upper),
            "bb_lower": F.when(has20, lower),
            "bb_width": F.when(has20, F.try_divide(upper - lower, F.col("_mid")) * 100.0),
            "atr": F.when(pos < 13, F.lit(0.0)).otherwise(F.col("_atr")),
            "volume_ratio": F.try_divide(F.col("volume"), F.col("volume_sma20")),
        }
    ).withColumn("macd_diff", F.col("macd") - F.col("macd_signal"))
    helpers = ["_mid", "_dev", "_up", "_dn", "_tr", "_tr14", "_e12", "_e26", "_e20", "_e50", "_gain", "_loss", "_atr", "_signal"]
    return df.drop(*helpers)


def with_indicators(
    bars: DataFrame, keys: Sequence[str] = ("ticker",), after: int = 0, block_rows: int = BLOCK_ROWS,
    size: str | None = None,
) -> DataFrame:
    """Blocked bars with indicators; copies are kept so that scores and outcomes can look around."""
    return add_indicators_to_blocks(lay_out(bars, keys, "ts", HALO_ROWS, after, block_rows, size), keys)


def indicator_frame(bars: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Bars with ``pos`` and the twelve indicator columns, one row per bar."""
    return owned(with_indicators(bars, keys))
