"""Hand-made bars with exact exits, then a random series against the plain loop."""
import numpy as np
import pandas as pd
import pytest

from barloom.config import BacktestConfig
from barloom.plans import backtest as bt

CFG = BacktestConfig(warmup_bars=50, max_holding_bars=3, stop_loss_pct=0.05, take_profit_pct=0.10, slippage_bps=10, commission_bps=5)


def frame(spark, rows, ticker="T"):
    pdf = pd.DataFrame(rows, columns=["open", "high", "low", "close", "score"])
    pdf.insert(0, "ticker", ticker)
    pdf.insert(1, "ts", pd.date_range("2020-01-01", periods=len(pdf), freq="D"))
    pdf.insert(2, "pos", range(len(pdf)))
    return pdf, spark.createDataFrame(pdf)


FLAT = (100.0, 101.0, 99.0, 100.0, 0)


@pytest.mark.parametrize("bars,reason,price", [
    ([(90.0, 91.0, 89.0, 90.0)], "stop", None),
    ([(100.0, 100.0, 94.0, 99.0)], "stop", 95.0),
    ([(100.0, 111.0, 99.0, 100.0)], "target", 110.0),
    ([(100.0, 111.0, 94.0, 100.0)], "stop", 95.0),
    ([FLAT[:4], (94.0, 96.0, 93.0, 95.0)], "gap_stop", 94.0),
    ([FLAT[:4], (112.0, 113.0, 111.0, 112.0)], "gap_target", 112.0),
    ([FLAT[:4], FLAT[:4], (100.0, 102.0, 99.0, 101.5)], "time_exit", 101.5),
])
def test_exits(spark, bars, reason, price):
    cfg = BacktestConfig(warmup_bars=50)
    rows = [FLAT] * 50 + [(*FLAT[:4], 60)] + [(*b, 0) for b in bars] + [FLAT] * 4
    rows[49] = FLAT
    _, df = frame(spark, rows)
    trade = bt.potential_trades(df, cfg).filter("pos = 50").first()
    if price is None:
        assert trade.raw_entry_price == 90.0
    else:
        assert (trade.exit_reason, pytest.approx(price)) == (reason, trade.raw_exit_price)


def loop(p, cfg):
    cash, last, trades, ledger = cfg.initial_capital, -1, [], []
    n = len(p)
    for i in range(cfg.warmup_bars - 1, n):
        if p.score[i] < cfg.min_score:
            ledger.append("below_threshold")
        elif i + 1 <= last or (trades and trades[-1]["x"] > i):
            ledger.append("overlap")
        elif i + 1 >= n:
            ledger.append("no_next_bar")
        else:
            fill = p.open[i + 1] * (1 + cfg.slippage_bps / 1e4)
            stop, target = fill * (1 - cfg.stop_loss_pct), fill * (1 + cfg.take_profit_pct)
            end = min(i + cfg.max_holding_bars, n - 1)
            for j in range(i + 1, end + 1):
                if p.open[j] <= stop or p.open[j] >= target:
                    x, px = j, p.open[j]
                    break
                if p.low[j] <= stop:
                    x, px = j, stop
                    break
                if p.high[j] >= target:
                    x, px = j, target
                    break
                if j == end:
                    x, px = j, p.close[j]
            factor = px * (1 - cfg.slippage_bps / 1e4) * (1 - cfg.commission_bps / 1e4) / (fill * (1 + cfg.commission_bps / 1e4))
            cash *= factor
            trades.append({"s": i, "x": x, "factor": factor, "cash": cash})
            last = x
            ledger.append("executed")
    return trades, ledger


def test_random_series_against_loop(spark):
    rng = np.random.default_rng(11)
    frames = []
    for t, n in (("HOT", 700), ("B", 90)):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        o = c * (1 + rng.normal(0, 0.02, n))
        frames.append(pd.DataFrame({
            "ticker": t, "ts": pd.date_range("2020-01-01", periods=n, freq="D"), "pos": range(n), "open": o, "high": np.maximum(o, c) * 1.02, "low": np.minimum(o, c) * 0.98,
            "close": c, "score": rng.choice([0, 60], n),
        }))
    out = bt.run_backtest(None, CFG, scored=spark.createDataFrame(pd.concat(frames)), block_rows=64)
    trades = out["trades"].toPandas()
    ledger = out["signals"].toPandas()
    equity = out["equity"].toPandas()
    for p in frames:
        t = p.ticker[0]
        want, states = loop(p, CFG)
        mine = trades[trades.ticker == t].sort_values("signal_pos")
        assert mine.signal_pos.tolist() == [w["s"] for w in want]
        assert mine.exit_pos.tolist() == [w["x"] for w in want]
        np.testing.assert_allclose(mine.ending_cash, [w["cash"] for w in want], rtol=1e-10)
        led = ledger[ledger.ticker == t].sort_values("pos")
        assert led.skip_reason.fillna("executed").tolist() == states
        eq = equity[equity.ticker == t].sort_values("pos")
        assert eq.equity.iloc[-1] == pytest.approx(want[-1]["cash"], rel=1e-9) or eq.position_open.iloc[-1]
        np.testing.assert_allclose(eq.running_peak, eq.equity.cummax(), rtol=1e-12)


def test_config_is_checked():
    with pytest.raises(ValueError):
        BacktestConfig(warmup_bars=10)
    with pytest.raises(ValueError):
        BacktestConfig(intrabar_policy="both")


def test_user_scorer_output_is_checked(spark):
    _, df = frame(spark, [FLAT] * 60)
    bad = bt.with_user_scorer(df.drop("score"), lambda d: d.selectExpr("ticker", "pos", "101.0 AS score"))
    with pytest.raises(Exception, match="within 0..100"):
        bad.collect()
