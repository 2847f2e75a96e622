import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import AlertCooldowns, PATTERN_PROFILES
from barloom.operators import calendar as cal
from barloom.plans import alerts as al
from barloom.plans import history as hs
from barloom.plans import options as op
from barloom.plans import premarket as pm
from barloom.sinks import tables as tb
from barloom.sources import bars as src
from barloom.streaming import bars as sb
from barloom.streaming import passes as ps
from barloom.streaming import sessions as ses

COOL = AlertCooldowns(default_minutes=60, by_type={"coil": 120})


def alert_rows(spark):
    t = pd.Timestamp("2024-01-02 10:00")
    rows = [("AAA", "coil", "short", t + pd.Timedelta(minutes=m), ok) for m, ok in ((0, False), (5, True), (60, True), (124, True), (125, True), (300, True))]
    rows += [("BBB", "coil", "short", t + pd.Timedelta(seconds=x), ok) for x, ok in ((0.1, False), (0.2, True), (1.0, True), (7_200.199999, True), (7_200.2, True))]
    rows += [("AAA", "gap_large", "short", t + pd.Timedelta(minutes=m), True) for m in (0, 59, 60)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["ticker", "alert_type", "timeframe", "observed_at", "delivered"]))


def test_cooldown_batch_and_stream_agree(spark, tmp_path):
    df = alert_rows(spark)
    batch = {(r.ticker, r.alert_type, r.observed_at): r.decision for r in al.decide(df, COOL).collect()}
    coil = [d for (t, k, _), d in sorted(batch.items()) if (t, k) == ("AAA", "coil")]
    assert [d for (t, _, _), d in sorted(batch.items()) if t == "BBB"] == ["failed", "sent", "suppressed", "suppressed", "sent"]
    assert coil == ["failed", "sent", "suppressed", "suppressed", "sent", "sent"]
    late = spark.createDataFrame(pd.DataFrame([("ZZZ", "coil", "short", pd.Timestamp("2024-01-03"), True)], columns=df.columns))  # moves the watermark past all others
    df.orderBy(F.desc("observed_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("tie", F.lit(""))
    sb.run_available(ses.cooldown_decisions(stream, COOL, "tie"), str(tmp_path / "out"), str(tmp_path / "ck"), settings=ses.STATE_STORE)
    streamed = {(r.ticker, r.alert_type, r.observed_at): r.decision for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == batch
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load(str(tmp_path / "ck"))
    assert {r.key.ticker for r in waiting.collect()} == {"ZZZ"}


def test_session_vwap_stream_replaces_versions_and_forgets_sessions(spark, tmp_path):
    at = lambda d, h: pd.Timestamp(f"2024-01-{d:02d} {h:02d}:00")
    cols = ["ticker", "ts", "open", "high", "low", "close", "volume", "arrival", "received_at"]
    first = [("a", at(2, 15), 1.0, 2.0, 1.0, 3.0, 10.0, 0, at(2, 16)), ("a", at(2, 16), 1.0, 9.0, 1.0, 2.0, 10.0, 0, at(2, 17)), ("a", at(28, 15), 1.0, 1.0, 1.0, 1.0, 1.0, 0, at(2, 17))]
    second = [("a", at(2, 16), 1.0, 6.0, 1.0, 2.0, 20.0, 2, at(2, 17)), ("a", at(2, 16), 1.0, 7.0, 1.0, 2.0, 20.0, 1, at(2, 17)), ("a", at(4, 16), 1.0, 3.0, 1.0, 2.0, 10.0, 0, at(4, 17))]
    for rows in (first, second):
        spark.createDataFrame(pd.DataFrame(rows, columns=cols)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sb.run_available(ses.session_vwaps(stream), str(tmp_path / "out"), str(tmp_path / "ck"), settings=ses.STATE_STORE)
    out = {r.kind: r for r in spark.read.schema(ses.OUT).parquet(str(tmp_path / "out")).collect()}
    assert set(out) == {"session", "future_bar"} and out["future_bar"].bar_time == at(28, 15)
    assert out["session"].bars == 2 and out["session"].vwap == pytest.approx((2.0 * 10 + 3.0 * 20) / 30)
    held = spark.read.format("statestore").option("stateVarName", "bars").load(str(tmp_path / "ck"))
    assert [str(r.key.session_date) for r in held.collect()] == ["2024-01-04"]


def test_trading_day_pass_runs_once(spark, tmp_path):
    days = spark.createDataFrame([("2024-01-05",), ("2024-01-06",), ("2024-01-08",)], "d string").select(F.to_date("d").alias("session_date"))
    sessions = cal.sessions_from_days(days)
    bars = lambda *ts: spark.createDataFrame([(pd.Timestamp(t).to_pydatetime(), 1.0) for t in ts], "ts timestamp, high double").coalesce(1)
    bars("2024-01-05 15:00", "2024-01-06 15:00").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, high double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda ck: ps.run_pass(stream, sessions, lambda b: b.select("scan_date", "high"), str(tmp_path / "t"), "q", str(tmp_path / ck))
    run("ck")
    run("ck")
    run("lost")  # a checkpoint that is gone replays the batch into its own folder
    ledger, results = ps.committed(spark, str(tmp_path / "t"))
    assert {(str(r.scan_date), r.trading_date is None, r.status, r.landed_rows) for r in ledger.collect()} == {("2024-01-05", False, "scanned", 1), ("2024-01-06", True, "skipped_closed", 1)}
    assert ledger.count() == 2 and [str(r.scan_date) for r in results.collect()] == ["2024-01-05"]
    bars("2024-01-08 15:00").write.mode("append").parquet(str(tmp_path / "in"))
    run("ck")
    ledger, results = ps.committed(spark, str(tmp_path / "t"))
    assert ledger.count() == 3 and results.count() == 2 and {r.batch_id for r in ledger.collect()} == {0, 1}
    spark.createDataFrame([("2024-01-05", 9.0)], "scan_date string, high double").selectExpr("CAST(scan_date AS DATE) AS scan_date", "high").write.parquet(str(tmp_path / "t/results/query_id=q/batch_id=7"))
    assert ps.committed(spark, str(tmp_path / "t"))[1].count() == 2  # results without a ledger are not committed


def test_alerts_of_one_instant_go_by_the_tie_columns(spark):
    rows = [("A", "coil", "short", pd.Timestamp("2024-01-02"), ok, i) for i, ok in enumerate((False, True, True, False))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ticker", "alert_type", "timeframe", "observed_at", "delivered", "n"]))
    got = {r.n: r.decision for r in al.decide(df, COOL, ["n"]).collect()}
    assert got == {0: "failed", 1: "sent", 2: "suppressed", 3: "suppressed"}


def test_wide_order_and_long_bars(spark):
    df = spark.createDataFrame([(1, 2**62), (1, 2**62 + 1), (2**55, -(2**62)), (0, 2**63 - 1), (-(2**55), 0)], "a bigint, b bigint")
    rows = [(r.a, r.b) for r in df.orderBy(src.wide_order(F.col("a"), F.col("b"))).collect()]
    assert rows == sorted(rows)
    assert src.event_bars(spark, "/root/testdata/sf0.001", 390).count() > 0


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    pdf = pd.DataFrame({"event_id": range(400), "ts": pd.date_range("2024-01-01", periods=400, freq="97s"), "event_type": ["a", "b"] * 200, "value": [float(i % 37) for i in range(400)]})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "in"))
    ticks = sb.stream_ticks(spark, str(tmp_path / "in"), "event_id bigint, ts timestamp, event_type string, value double", "*.parquet", "ts", "event_type", "value", "event_id")
    sb.run_available(sb.stream_bars(ticks, 60), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["ticker", "ts"])
    hours = pdf.assign(hour=pdf.ts.dt.floor("h"))
    done = hours[hours.hour + pd.Timedelta(hours=1) <= pdf.ts.max() - pd.Timedelta(minutes=10)]
    want = done.groupby(["event_type", "hour"]).value.agg(["first", "max", "min", "last", "count"]).reset_index().sort_values(["event_type", "hour"])
    assert got[["open", "high", "low", "close", "volume"]].to_numpy().tolist() == want[["first", "max", "min", "last", "count"]].astype(float).to_numpy().tolist()


def test_append_scan_rejects_a_repeated_session(spark, tmp_path):
    session = spark.createDataFrame([("s1", "short")], "session_id string, timeframe string")
    rows = spark.createDataFrame([("s1", "A", 50)], "session_id string, ticker string, score int")
    tb.append_scan(str(tmp_path), session, rows, rows, session)
    with pytest.raises(ValueError):
        tb.append_scan(str(tmp_path), session, rows, rows, session)
    assert spark.read.parquet(str(tmp_path / "scan_observations")).count() == 1


def test_symbol_months_upsert_and_csv(spark, tmp_path):
    bars = spark.createDataFrame(pd.DataFrame({"ticker": ["A", "A", "B"], "ts": pd.to_datetime(["2024-01-02", "2024-02-01", "2024-01-05"]), "close": [1.0, 2.0, 3.0]}))
    tb.write_symbol_months(bars, str(tmp_path / "m"))
    eligible = spark.createDataFrame([("2024-01", "A")], "effective_month string, symbol string")
    assert src.read_parquet_months(spark, str(tmp_path / "m"), eligible).count() == 1
    assert tb.symbol_month_stats(spark, str(tmp_path / "m")).count() == 3
    old = spark.createDataFrame([("k", 1, "old"), ("z", 1, "keep")], "k string, v int, t string")
    new = spark.createDataFrame([("k", 2, "new")], "k string, v int, t string")
    assert {r.k: r.t for r in tb.upsert_latest(old, new, ["k"], "v").collect()} == {"k": "new", "z": "keep"}
    tb.write_csv(spark.createDataFrame([(1 / 3, ["a", "b"])], "x double, r array<string>"), str(tmp_path / "csv"), 4)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().asDict() == {"x": "0.3333", "r": "a|b"}


def test_csv_source_needs_a_zone_for_naive_times(spark, tmp_path):
    (tmp_path / "abc.csv").write_text("date,open,high,low,close,volume\n2024-01-02 09:30,1,2,1,2,10\n")
    naive = src.read_csv_bars(spark, str(tmp_path / "abc.csv")).first()
    zoned = src.read_csv_bars(spark, str(tmp_path / "abc.csv"), "America/New_York").first()
    assert naive.ts is None and zoned.ts.hour == 14 and zoned.ticker == "abc"


def test_candles_keep_the_last_duplicate(spark):
    payload = json.dumps({"candles": [{"datetime": 1704207600000, "open": 1, "high": 1, "low": 1, "close": 1, "volume": 1}, {"datetime": 1704207600000, "open": 2, "high": 2, "low": 2, "close": 2, "volume": 2}, {"datetime": "bad", "open": 1}]})
    rows = src.normalize_candles(spark.createDataFrame([("A", payload)], "ticker string, payload string")).collect()
    assert len(rows) == 1 and rows[0].close == 2.0


def test_calendar_handles_daylight_saving_and_early_close(spark):
    days = spark.createDataFrame([("2024-01-15",), ("2024-07-03",), ("2024-07-06",)], "d string").select(F.to_date("d").alias("session_date"))
    s = {str(r.session_date): r for r in cal.sessions_from_days(days, early_close=F.col("session_date") == "2024-07-03").collect()}
    assert s["2024-01-15"].opens_at.hour == 14 and s["2024-07-03"].opens_at.hour == 13 and s["2024-07-03"].closes_at.hour == 17 and "2024-07-06" not in s


def test_outcome_counts_sessions_before_dropping_null_closes(spark):
    daily = spark.createDataFrame(pd.DataFrame({"ticker": "A", "ts": pd.to_datetime(["2024-01-03", "2024-01-04", "2024-01-05", "2024-01-08"]), "close": [None, 11.0, None, 13.0]}))
    daily = src.nan_to_null(daily, ["close"])  # missing numbers are NULL from ingest on
    sig = spark.createDataFrame(pd.DataFrame({"id": [1, 2], "ticker": "A", "timeframe": ["short", "long"], "scan_time": pd.to_datetime("2024-01-02"), "last_close": 10.0, "provider": "p", "score": 50}))
    out = {r.id: (r.outcome_close, r.outcome_status) for r in hs.resolve_outcomes(sig, daily, "2024-01-31").collect()}
    assert out == {1: (13.0, "resolved"), 2: (None, "pending")}


def test_options_rules(spark):
    rows = spark.createDataFrame([("A", "CALL", 10.0, 0.0), ("A", "PUT", 7.0, 7.0), ("B", "PUT", 1.0, None)], "ticker string, type string, volume double, open_interest double")
    r = rows.withColumn("vol_oi_ratio", op.vol_oi_ratio(F.col("volume"), F.col("open_interest")))
    assert [x.vol_oi_ratio for x in r.collect()] == [None, 1.0, None]
    balance = {x.ticker: x.volume_balance for x in op.put_call_activity(rows).collect()}
    assert balance == {"A": "balanced", "B": "put_only"}


def test_spread_and_staleness(spark):
    t = F.lit("2024-01-05 12:00").cast("timestamp")
    spread = lambda b, a: pm.spread_bps(F.lit(b), F.lit(a), F.lit(None).cast("timestamp"), t)
    row = spark.range(1).select(spread(99.0, 101.0), spread(101.0, 99.0), spread(0.0, 1.0)).first()
    assert row[0] == pytest.approx(200.0) and row[1] is None and row[2] is None
    stale = lambda a, b: cal.is_stale(F.lit(a).cast("date"), F.lit(b).cast("date"))
    got = spark.range(1).select(stale("2024-01-05", "2024-01-08"), stale("2024-01-04", "2024-01-08"), stale("2024-01-06", "2024-01-08")).first()
    assert tuple(got) == (False, True, False)


def test_watchlists(spark):
    empty = spark.createDataFrame([], "name string, ticker string, pos int, created_at timestamp, updated_at timestamp")
    one = tb.save_watchlist(empty, "w", spark.createDataFrame([(" $b ", 0), ("a", 1), ("B", 2)], "ticker string, pos int"), "2024-01-01")
    two = tb.save_watchlist(one, "w", spark.createDataFrame([("c", 0)], "ticker string, pos int"), "2024-02-01")
    assert [r.ticker for r in tb.load_watchlist(one, "w").collect()] == ["B", "A"]
    r = tb.list_watchlists(two).first()
    assert r.tickers == 1 and r.created_at.month == 1 and r.updated_at.month == 2


def test_stream_keeps_only_what_may_still_be_preceded(spark, tmp_path):
    """A dense batch is decided at once except for the last hour of its key; the decisions are those of the table."""
    t = pd.Timestamp("2024-01-02 10:00")
    rows = [("AAA", "coil", "short", t + pd.Timedelta(seconds=2 * ((i * 7919) % 20_000)), i % 5 != 0) for i in range(20_000)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ticker", "alert_type", "timeframe", "observed_at", "delivered"]))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("tie", F.lit(""))
    sb.run_available(ses.cooldown_decisions(stream, COOL, "tie"), str(tmp_path / "out"), str(tmp_path / "ck"), settings=ses.STATE_STORE)
    batch = {r.observed_at: r.decision for r in al.decide(df, COOL).collect()}
    out = {r.observed_at: r.decision for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    end = max(batch)
    assert out == {at: d for at, d in batch.items() if at < end - pd.Timedelta(hours=1)}
    waiting = spark.read.format("statestore").option("batchId", 0).option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load(str(tmp_path / "ck"))
    assert waiting.count() == 20_000 - len(out)
