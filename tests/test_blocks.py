"""Blocked windows against plain pandas, with small blocks so that many edges are crossed."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.blocks import block_window, lay_out, number_rows, owned, running_peak, running_total
from barloom.operators.indicators import INDICATOR_COLUMNS, with_indicators


def series(n, seed, ticker, freq="5min"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return pd.DataFrame({
        "ticker": ticker, "ts": pd.date_range("2020-01-01", periods=n, freq=freq), "open": close * (1 + rng.normal(0, 0.002, n)),
        "high": close * 1.01, "low": close * 0.99, "close": close, "volume": rng.integers(1, 1000, n).astype(float),
    })


@pytest.fixture(scope="module")
def bars(spark):
    # one ticker holds most rows
    pdf = pd.concat([series(45_000, 1, "HOT"), series(400, 2, "B"), series(60, 3, "C"), series(10, 4, "D")])
    return pdf, spark.createDataFrame(pdf)


def ema(x, n):
    return x.ewm(span=n, min_periods=n, adjust=False).mean()


def expected(p):
    c, v = p.close, p.volume
    d = c.diff()
    up = d.where(d > 0, 0.0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    dn = (-d.where(d < 0, 0.0)).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    macd = ema(c, 12) - ema(c, 26)
    signal = ema(macd, 9)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(19, np.nan), c]), 20)  # rolling sums drift on long series
    mid, dev = pd.Series(windows.mean(axis=1)), pd.Series(windows.std(axis=1))
    tr = pd.concat([p.high - p.low, (p.high - c.shift()).abs(), (p.low - c.shift()).abs()], axis=1).max(axis=1).to_numpy()
    atr = np.zeros(len(p))
    if len(p) >= 14:
        atr[13] = tr[:14].mean()
        for i in range(14, len(p)):
            atr[i] = (atr[i - 1] * 13 + tr[i]) / 14
    return pd.DataFrame({
        "rsi": 100 - 100 / (1 + up / dn), "macd": macd, "macd_signal": signal, "macd_diff": macd - signal, "ema_20": ema(c, 20), "ema_50": ema(c, 50),
        "bb_upper": mid + 2 * dev, "bb_lower": mid - 2 * dev, "bb_width": 4 * dev / mid * 100, "atr": atr, "volume_sma20": v.rolling(20).mean(), "volume_ratio": v / v.rolling(20).mean(),
    })


@pytest.mark.parametrize("block_rows", [20_480, 65_536])
def test_indicators_match_pandas_across_blocks(bars, block_rows):
    pdf, df = bars
    got = owned(with_indicators(df, block_rows=block_rows)).toPandas()
    assert len(got) == len(pdf)
    for ticker, p in pdf.groupby("ticker"):
        want = expected(p.reset_index(drop=True))
        mine = got[got.ticker == ticker].sort_values("pos").reset_index(drop=True)
        for c in INDICATOR_COLUMNS:
            np.testing.assert_allclose(mine[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-8, err_msg=f"{ticker} {c}")


def halted(ticker, moving, flat, seed):
    p = series(moving + flat, seed, ticker)
    for c in ("open", "high", "low", "close"):
        p.loc[moving:, c] = p.close[moving - 1]
    return p


@pytest.mark.parametrize("block_rows", [20_480, 24_000, 65_536])
def test_averages_equal_the_recursion_on_flat_stretches(spark, block_rows):
    pdf = pd.concat([halted("A", 300, 5_700, 5), halted("B", 19_900, 5_000, 6)])
    got = owned(with_indicators(spark.createDataFrame(pdf), block_rows=block_rows)).toPandas()
    for ticker, p in pdf.groupby("ticker"):
        move = np.diff(p.close.to_numpy())
        up = down = 0.0
        rsi = np.full(len(p), np.nan)
        for i in range(len(p)):
            if i:
                up, down = up * 13 / 14 + max(move[i - 1], 0.0) / 14, down * 13 / 14 + max(-move[i - 1], 0.0) / 14
            if i >= 13:
                rsi[i] = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
        mine = got[got.ticker == ticker].sort_values("pos")
        np.testing.assert_allclose(mine.rsi.astype(float), rsi, rtol=1e-9, err_msg=ticker)


def test_no_look_ahead(spark, bars):
    pdf, _ = bars
    one = pdf[pdf.ticker == "B"]
    full = owned(with_indicators(spark.createDataFrame(one))).toPandas().sort_values("pos").head(200)
    cut = owned(with_indicators(spark.createDataFrame(one.head(200)))).toPandas().sort_values("pos")
    for c in INDICATOR_COLUMNS:
        np.testing.assert_allclose(full[c].astype(float), cut[c].astype(float), rtol=1e-12)


def test_numbers_and_running_values(bars):
    pdf, df = bars
    numbered = number_rows(df, ["ticker"], "ts", bucket_seconds=86_400)
    out = running_peak(running_total(numbered, ["ticker"], {"cum": F.col("volume")}, 500), ["ticker"], {"peak": F.col("close")}, 500).toPandas()
    for ticker, p in pdf.groupby("ticker"):
        mine = out[out.ticker == ticker].sort_values("ts")
        assert mine.pos.tolist() == list(range(len(p)))
        np.testing.assert_allclose(mine.cum, p.volume.cumsum())
        np.testing.assert_allclose(mine.peak, p.close.cummax())


def test_look_around_copies(bars):
    pdf, df = bars
    w = block_window(["ticker"])
    out = owned(lay_out(df, ["ticker"], "ts", 3, 5, 64).withColumns({"back": F.lag("close", 3).over(w), "ahead": F.lead("close", 5).over(w)})).toPandas()
    hot = out[out.ticker == "HOT"].sort_values("pos").reset_index(drop=True)
    p = pdf[pdf.ticker == "HOT"].reset_index(drop=True)
    np.testing.assert_array_equal(hot.back.astype(float), p.close.shift(3))
    np.testing.assert_array_equal(hot.ahead.astype(float), p.close.shift(-5))


def test_plan_has_no_window_by_ticker_alone(bars):
    """Bars are never windowed by ticker only; the single such window is over bucket totals."""
    _, df = bars
    plan = with_indicators(df)._jdf.queryExecution().executedPlan().toString()
    ticker_only = [line for line in plan.splitlines() if "Window [" in line and "blk" not in line and "_bucket" not in line]
    assert not ticker_only
