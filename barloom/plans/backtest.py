"""Backtest of a scored bar series: next-open entry, stop/target/time exits, one position per ticker."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BacktestConfig
from ..functions.returns import BPS
from ..operators.blocks import BLOCK_ROWS, block_window, number_rows, owned, place_rows, running_peak, running_total
from ..operators.greedy import choose_non_overlapping
from ..operators.indicators import with_indicators
from ..operators.scores import add_short_score
from ..operators.stats import exact_quantiles
from ..session import settle

OHLC = ["open", "high", "low", "close"]


def scored_bars(bars: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(ticker, ts, pos, OHLC, score) of the built-in short scorer."""
    return owned(add_short_score(with_indicators(bars, ("ticker",), 0, block_rows))).select("ticker", "ts", "pos", *OHLC, "score")


def with_user_scorer(numbered: DataFrame, scorer) -> DataFrame:
    """Attach a user scorer ``DataFrame -> DataFrame(ticker, pos, score)``; scores must be within 0..100."""
    scored = numbered.join(scorer(numbered).select("ticker", "pos", "score"), ["ticker", "pos"])
    ok = F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")) & F.col("score").between(0, 100)
    return scored.withColumn(
        "score", F.when(ok, F.col("score")).otherwise(F.raise_error(F.lit("score must be a number within 0..100")))
    )


def _exit_of(bar, stop, target, last_pos, stop_first: bool):
    """Exit of one bar as (pos, ts, price, reason); reason is NULL when the position stays open."""
    gap_stop, gap_target = bar["open"] <= stop, bar["open"] >= target
    hit_stop, hit_target = bar["low"] <= stop, bar["high"] >= target
    first, second = (("stop", hit_stop, stop), ("target", hit_target, target))[:: 1 if stop_first else -1]
    reason = (
        F.when(gap_stop, "gap_stop").when(gap_target, "gap_target")
        .when(first[1], first[0]).when(second[1], second[0])
        .when(bar["pos"] == last_pos, "time_exit")
    )
    price = (
        F.when(gap_stop | gap_target, bar["open"])
        .when(first[1], first[2]).when(second[1], second[2]).otherwise(bar["close"])
    )
    return F.struct(bar["pos"].alias("pos"), bar["ts"].alias("ts"), price.alias("price"), reason.alias("reason"))


def potential_trades(scored: DataFrame, config: BacktestConfig, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every qualifying signal with a next bar, and the trade it would make alone."""
    h = config.max_holding_bars
    w = block_window(["ticker"])
    placed = place_rows(scored, ["ticker"], 0, h, block_rows)
    ahead = F.collect_list(F.struct("pos", "ts", *OHLC)).over(w.rowsBetween(1, h))
    slip, fee = config.slippage_bps / BPS, config.commission_bps / BPS
    signals = (
        owned(placed.withColumn("ahead", ahead))
        .filter((F.col("pos") >= config.warmup_bars - 1) & (F.col("score") >= config.min_score) & (F.size("ahead") > 0))
        .withColumn("raw_entry_price", F.col("ahead")[0]["open"])
        .withColumn("entry_fill_price", F.col("raw_entry_price") * (1 + slip))
        .withColumn("stop_price", F.col("entry_fill_price") * (1 - config.stop_loss_pct))
        .withColumn("target_price", F.col("entry_fill_price") * (1 + config.take_profit_pct))
    )
    last_pos = F.element_at("ahead", -1)["pos"]
    exits = F.transform(
        "ahead",
        lambda b: _exit_of(b, F.col("stop_price"), F.col("target_price"), last_pos, config.intrabar_policy == "stop_first"),
    )
    exit_ = F.filter(exits, lambda e: e["reason"].isNotNull())[0]
    out = signals.withColumn("exit", exit_).select(
        "ticker", "pos", F.col("ts").alias("signal_time"), "score",
        F.col("ahead")[0]["ts"].alias("entry_time"),
        F.col("exit.ts").alias("exit_time"), F.col("exit.pos").alias("exit_pos"), F.col("exit.reason").alias("exit_reason"),
        "raw_entry_price", "entry_fill_price", "stop_price", "target_price",
        F.col("exit.price").alias("raw_exit_price"),
        (F.col("exit.pos") - F.col("pos")).alias("bars_held"),
    )
    factor = (F.col("raw_exit_price") * (1 - slip)) * (1 - fee) / (F.col("entry_fill_price") * (1 + fee))
    return out.withColumns(
        {
            "exit_fill_price": F.col("raw_exit_price") * (1 - slip),
            "gross_return_pct": (F.col("raw_exit_price") / F.col("raw_entry_price") - 1) * 100,
            "factor": factor,
            "net_return_pct": (factor - 1) * 100,
        }
    )


def executed_trades(potential: DataFrame, config: BacktestConfig) -> DataFrame:
    """Trades actually taken (a signal before the last exit is skipped), with compounded cash."""
    width = max(4_096, config.max_holding_bars + 1)
    chosen = choose_non_overlapping(potential, ["ticker"], "pos", "exit_pos", width)
    taken = potential.join(chosen, ["ticker", "pos"]).withColumnRenamed("pos", "signal_pos")
    ordered = number_rows(taken, ["ticker"], "entry_time")
    grown = running_total(ordered, ["ticker"], {"_log": F.log("factor")})
    capital = F.lit(config.initial_capital)
    return grown.withColumns(
        {
            "ending_cash": capital * F.exp("_log"),
            "starting_cash": capital * F.exp(F.col("_log") - F.log("factor")),
        }
    ).withColumn(
        "quantity", F.col("starting_cash") / (F.col("entry_fill_price") * (1 + config.commission_bps / BPS))
    ).drop("_log").withColumnRenamed("pos", "trade_no")


def _bars_with_trades(scored: DataFrame, trades: DataFrame, config: BacktestConfig, block_rows: int) -> DataFrame:
    """Evaluated bars with the trade whose holding period covers or blocks them, from a bounded look-back."""
    h = config.max_holding_bars
    marks = trades.select(
        "ticker", F.col("signal_pos").alias("pos"),
        F.struct("signal_pos", "exit_pos", "entry_fill_price").alias("trade"),
    )
    w = block_window(["ticker"])
    placed = place_rows(
        scored.filter(F.col("pos") >= config.warmup_bars - 1).join(marks, ["ticker", "pos"], "left"),
        ["ticker"], h + 1, 0, block_rows,
    )
    return owned(placed.withColumn("last", F.last("trade", ignorenulls=True).over(w.rowsBetween(-h, -1))))


def signal_ledger(scored: DataFrame, trades: DataFrame, config: BacktestConfig, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every evaluated bar: executed, or skipped with its reason."""
    bars = _bars_with_trades(scored, trades, config, block_rows)
    blocked = F.coalesce(F.col("last.exit_pos") > F.col("pos"), F.lit(False))
    reason = (
        F.when(F.col("score") < config.min_score, "below_threshold")
        .when(blocked, "overlap")
        .when(F.col("trade").isNull(), "no_next_bar")
    )
    return bars.withColumn("skip_reason", reason).select(
        "ticker", F.col("ts").alias("signal_time"), "pos", "score", F.col("close").alias("signal_close"),
        F.when(F.col("skip_reason").isNull(), "executed").otherwise("skipped").alias("execution_status"), "skip_reason",
    )


def equity_curve(scored: DataFrame, trades: DataFrame, config: BacktestConfig, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bar-level equity marked at the close, with exposure, return, peak and drawdown."""
    exits = trades.select("ticker", F.col("exit_pos").alias("pos"), F.log("factor").alias("_realized"))
    bars = _bars_with_trades(scored, trades, config, block_rows).join(exits, ["ticker", "pos"], "left")
    summed = running_total(bars, ["ticker"], {"_log": F.coalesce("_realized", F.lit(0.0))}, block_rows)
    open_ = F.coalesce(F.col("last.exit_pos") >= F.col("pos"), F.lit(False))
    held = F.coalesce(F.col("last.exit_pos") > F.col("pos"), F.lit(False))
    cash = F.lit(config.initial_capital) * F.exp("_log")
    quantity = cash / (F.col("last.entry_fill_price") * (1 + config.commission_bps / BPS))
    curve = summed.select(
        "ticker", "ts", "pos", "close", open_.alias("position_open"),
        F.when(held, quantity).otherwise(0.0).alias("position_quantity"),
        F.when(held, 0.0).otherwise(cash).alias("cash"),
        F.when(held, quantity * F.col("close")).otherwise(cash).alias("equity"),
    )
    peaked = running_peak(curve, ["ticker"], {"running_peak": F.col("equity")}, block_rows)
    w = block_window(["ticker"])
    placed = place_rows(peaked, ["ticker"], 1, 0, block_rows)
    return owned(placed.withColumn("previous", F.lag("equity").over(w))).withColumns(
        {
            "daily_return": F.try_divide(F.col("equity"), F.col("previous")) - 1,
            "drawdown_pct": (F.col("equity") / F.col("running_peak") - 1) * 100,
        }
    ).drop("previous")


def buy_and_hold(scored: DataFrame, config: BacktestConfig) -> DataFrame:
    """Same-cost return from the first evaluated open to the last close."""
    slip, fee = config.slippage_bps / BPS, config.commission_bps / BPS
    span = scored.filter(F.col("pos") >= config.warmup_bars - 1).groupBy("ticker").agg(
        F.min_by("open", "pos").alias("_in"), F.max_by("close", "pos").alias("_out")
    )
    value = F.col("_out") * (1 - slip) * (1 - fee) / (F.col("_in") * (1 + slip) * (1 + fee))
    return span.select("ticker", ((value - 1) * 100).alias("buy_and_hold_return_pct"))


def backtest_metrics(curve: DataFrame, trades: DataFrame, ledger: DataFrame, hold: DataFrame, config: BacktestConfig) -> DataFrame:
    """One row of metrics per ticker."""
    r = F.col("daily_return")
    equity = curve.groupBy("ticker").agg(
        F.max_by("equity", "pos").alias("ending_capital"),
        F.min("drawdown_pct").alias("max_drawdown_pct"),
        (F.count_if("position_open") / F.count(F.lit(1)) * 100).alias("exposure_pct"),
        F.count(r).alias("_n"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_std"),
    )
    x, pnl = F.col("net_return_pct"), F.col("ending_cash") - F.col("starting_cash")
    win, loss = x > 1e-9, x < -1e-9
    closed = trades.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("total_trades"), F.count_if(win).alias("winning_trades"), F.count_if(loss).alias("losing_trades"),
        F.avg(x).alias("average_trade_return_pct"),
        F.avg(F.when(win, x)).alias("average_win_pct"), F.avg(F.when(loss, x)).alias("average_loss_pct"),
        F.sum(F.when(pnl > 0, pnl)).alias("_gain"), F.sum(F.when(pnl < 0, -pnl)).alias("_loss"),
    )
    medians = exact_quantiles(trades, ["ticker"], "net_return_pct", {"median_trade_return_pct": 0.5})
    signals = ledger.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("total_signals"),
        F.count_if(F.col("score") >= config.min_score).alias("qualifying_signals"),
        F.count_if(F.col("skip_reason") == "overlap").alias("signals_skipped_overlap"),
        F.count_if(F.col("skip_reason") == "no_next_bar").alias("signals_skipped_no_next_bar"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = equity.join(hold, "ticker").join(signals, "ticker").join(closed, "ticker", "left").join(medians, "ticker", "left")
    total = (F.col("ending_capital") / config.initial_capital - 1) * 100
    return out.select(
        "ticker", "ending_capital", total.alias("total_return_pct"), "buy_and_hold_return_pct",
        (total - F.col("buy_and_hold_return_pct")).alias("excess_return_pct"),
        "total_signals", "qualifying_signals", "signals_skipped_overlap", "signals_skipped_no_next_bar",
        zero(F.col("total_trades")).alias("total_trades"), zero(F.col("winning_trades")).alias("winning_trades"),
        zero(F.col("losing_trades")).alias("losing_trades"),
        zero(F.col("total_trades") - F.col("winning_trades") - F.col("losing_trades")).alias("breakeven_trades"),
        (F.col("winning_trades") / F.col("total_trades") * 100).alias("win_rate_pct"),
        "average_trade_return_pct", "median_trade_return_pct", "average_win_pct", "average_loss_pct",
        F.col("average_trade_return_pct").alias("expectancy_pct"),
        F.when(F.col("_loss").isNotNull(), F.coalesce(F.col("_gain"), F.lit(0.0)) / F.col("_loss")).alias("profit_factor"),
        F.when((F.col("_n") >= 2) & (F.col("_std") > 0), F.sqrt(F.lit(252.0)) * F.try_divide(F.col("_mean"), F.col("_std"))).alias("sharpe_ratio"),
        "max_drawdown_pct", "exposure_pct",
    )


def run_backtest(bars: DataFrame, config: BacktestConfig, scored: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> dict[str, DataFrame]:
    """All four tables of a backtest."""
    scored = settle(scored_bars(bars, block_rows) if scored is None else scored)
    trades = settle(executed_trades(settle(potential_trades(scored, config, block_rows)), config))
    ledger = signal_ledger(scored, trades, config, block_rows)
    curve = equity_curve(scored, trades, config, block_rows)
    return {
        "trades": trades, "signals": ledger, "equity": curve,
        "metrics": backtest_metrics(curve, trades, ledger, buy_and_hold(scored, config), config),
    }
