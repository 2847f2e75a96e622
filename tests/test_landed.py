"""Landed files, pruned partitions, feeds on the grid, versioned tables."""
import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import calendar as cal
from barloom.plans import feeds as fd
from barloom.sinks import tables as tb
from barloom.sinks import versions as vs
from barloom.sources import landed as ld


def test_ineligible_symbol_months_are_not_read(spark, tmp_path):
    days = pd.date_range("2024-01-01", "2024-06-30", freq="D")
    bars = pd.DataFrame([(t, d, 1.0) for t in "ABCDEFGH" for d in days], columns=["ticker", "ts", "close"])
    tb.write_symbol_months(spark.createDataFrame(bars), str(tmp_path / "m"))
    files = tb.symbol_month_stats(spark, str(tmp_path / "m"))
    assert files.count() == 48
    quality = files.select("effective_month", "symbol", (F.col("symbol") != "B").alias("usable"))
    universe = spark.createDataFrame([("2024-02", "A", "stock"), ("2024-02", "A", "stock"), ("2024-02", "B", "stock"), ("2024-03", "C", "etf"), ("2025-01", "A", "stock")], "effective_month string, symbol string, security_type string")
    universe.write.parquet(str(tmp_path / "u"))
    eligible = ld.eligible_months(files, quality, spark.read.parquet(str(tmp_path / "u")).filter("security_type <> 'x'"))
    assert sorted((r.effective_month, r.symbol) for r in eligible.collect()) == [("2024-02", "A"), ("2024-03", "C")]
    eligible.write.parquet(str(tmp_path / "e"))
    df = ld.read_eligible_months(spark, str(tmp_path / "m"), spark.read.parquet(str(tmp_path / "e")).filter("security_type <> 'x'"))
    assert df.count() == 29 + 31
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = ld.read_eligible_months(spark, str(tmp_path / "m"), spark.read.parquet(str(tmp_path / "e")).filter("security_type <> 'x'"))
        again.collect()
        scans = again._jdf.queryExecution().executedPlan().collectLeaves()
        read = [scans.apply(i).metrics().apply("numFiles").value() for i in range(scans.size()) if "dynamicpruning" in scans.apply(i).toString()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert read == [4]  # of 48 files: months and symbols are pruned one by one, two of each


def test_manifest_verdicts_and_chunked_hashes(spark, tmp_path, monkeypatch):
    root = tmp_path / "a b+c"
    (root / "sub").mkdir(parents=True)
    texts = {"good.csv": "x,y\n1,2\n3,4\n", "sub/short.csv": "x,y\n1,2\n", "changed.csv": "x,y\n9,9\n", "extra.csv": "x,y\n5,5\n", "sub/name with %20 and #.csv": "x,y\n7,7\n"}
    for name, text in texts.items():
        (root / name).write_text(text)
    digest = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in texts.items()}
    rows = [("good.csv", digest["good.csv"], 2), ("sub/short.csv", digest["sub/short.csv"], 2), ("changed.csv", "0" * 64, 1), ("sub/name with %20 and #.csv", digest["sub/name with %20 and #.csv"], 1),
            ("gone.csv", "0" * 64, 1), ("../a.csv", "0" * 64, 1), ("/etc/hosts", "0" * 64, 1), ("sub/../../x.csv", "0" * 64, 1)]
    manifest = spark.createDataFrame(rows, "relative_path string, sha256 string, rows bigint")
    bars, verdicts = ld.read_manifest_bars(spark, str(root), manifest, "x int, y int")
    got = {r.relative_path: r.verdict for r in verdicts.collect()}
    assert got == {"good.csv": "ok", "sub/short.csv": "row_mismatch", "changed.csv": "hash_mismatch", "extra.csv": "unlisted_file", "sub/name with %20 and #.csv": "ok",
                   "gone.csv": "missing_file", "../a.csv": "path_escape", "/etc/hosts": "path_escape", "sub/../../x.csv": "path_escape"}
    assert sorted((r.x, r.y) for r in bars.collect()) == [(1, 2), (3, 4), (7, 7)]
    big = b"0123456789" * 1_000_003  # more than one chunk
    (root / "big.bin").write_bytes(big)
    found = ld.hashed_files(spark.createDataFrame([("big.bin",), ("nothing",)], "relative_path string"), str(root)).collect()
    assert len(big) > ld.CHUNK and {r.relative_path: r.sha256 for r in found} == {"big.bin": hashlib.sha256(big).hexdigest(), "nothing": None}


def test_nested_records_and_bad_ones(spark, tmp_path):
    good = {"key": 7, "facts": {"Shares": {"label": "shares", "units": {"shares": [{"end": "2023-12-31", "val": 5, "form": "10-K", "filed": "2024-02-01"}], "USD": []}}, "None": {"units": {}}}}
    (tmp_path / "f.json").write_text(json.dumps(good) + "\n{\"key\": 8, \"facts\": {\n" + json.dumps({"key": 9}) + "\n")
    records = ld.read_json_records(spark, str(tmp_path / "f.json"), ld.FACTS).cache()
    assert records.count() == 3 and records.filter("_corrupt IS NOT NULL").count() == 1
    rows = ld.fact_rows(records).collect()
    assert [(r.key, r.concept, r.unit, r.value, str(r.filed)) for r in rows] == [(7, "Shares", "shares", 5.0, "2024-02-01")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/one.json").write_text(json.dumps({"pit_date": "2024-01-31", "state": "active", "rows": [{"ticker": "A", "name": "n", "extra": 1}, {"ticker": "B"}]}, indent=1))
    (tmp_path / "s/two.json").write_text('{"pit_date": "2024-01-31", "rows": [')
    whole = ld.read_json_records(spark, str(tmp_path / "s"), ld.SNAPSHOT, multi_line=True)
    assert sorted(r.ticker for r in ld.snapshot_rows(whole).collect()) == ["A", "B"]
    assert sum(r["_corrupt"] is not None for r in whole.select("state", "_corrupt").collect()) == 1


def test_feeds_on_the_grid(spark):
    days = spark.createDataFrame([("2024-01-08",), ("2024-01-09",), ("2024-01-10",)], "d string").select(F.to_date("d").alias("session_date"))
    sessions = cal.sessions_from_days(days, early_close=F.col("session_date") == "2024-01-10")
    grid = cal.session_grid(sessions, 30)  # 13 bars a full session
    rows = [("a", r.bar_start, 1.0, 1.0, 1.0, 1.0, 10.0) for r in grid.filter("session_date = '2024-01-08'").collect()]
    cols = "ticker string, ts timestamp, open double, high double, low double, close double, volume double"
    extra = [("a", pd.Timestamp("2024-01-09 03:00").to_pydatetime(), 1.0, 1.0, 1.0, 1.0, 0.0), ("a", pd.Timestamp("2024-01-10 15:00").to_pydatetime(), 1.0, 1.0, 1.0, 1.0, 1.0), ("a", pd.Timestamp("2024-01-09 15:07").to_pydatetime(), 1.0, 1.0, 1.0, 1.0, 1.0)]
    series = spark.createDataFrame([("a", "2024-01-08", "2024-01-10"), ("none", "2024-01-08", "2024-01-09")], "ticker string, a string, z string").select("ticker", F.to_date("a").alias("first_day"), F.to_date("z").alias("last_day"))
    feed = spark.createDataFrame(rows + extra, cols)
    got = {r.ticker: r for r in fd.feed_coverage(feed, series, sessions, grid, 30).collect()}
    a = got["a"]
    assert (a.expected_bars, a.primary_bars, a.missing_bars, a.extended_bars, a.early_close_bars, a.off_grid_bars, a.zero_volume_bars) == (26, 13, 13, 1, 1, 1, 1)
    assert a.coverage_pct == 50.0 and [str(d) for d in a.missing_sessions] == ["2024-01-09"] and a.threshold_result == "failed"
    assert got["none"].expected_bars == 26 and got["none"].raw_rows == 0 and len(got["none"].missing_sessions) == 2
    one_day = series.filter("ticker = 'a'").withColumn("last_day", F.col("first_day"))
    assert fd.feed_coverage(feed, one_day, sessions, grid, 30).first().threshold_result == "passed"
    half = feed.withColumn("volume", F.col("volume") / 2)
    kinds = lambda x, y, s=series: {r.ticker: r.classification for r in fd.feed_grid_comparison(x, y, s, grid).collect()}
    assert kinds(feed, feed) == {"a": "identical", "none": "not_comparable"}
    assert kinds(feed, half)["a"] == "same_timestamps_different_values" and kinds(feed, feed.withColumn("close", F.col("close") + 1))["a"] == "different_ohlc"
    assert kinds(feed, feed.limit(0))["a"] == "one_feed_empty"
    assert kinds(feed, feed.withColumn("ts", F.col("ts") + F.expr("INTERVAL 7 MINUTES")))["a"] == "no_overlap"
    r = fd.feed_grid_comparison(feed, half, series.filter("ticker = 'a'"), grid).first()
    assert r.paired_bars == 13 and r.median_volume_ratio == 0.5 and r.volume_ratio == 0.5 and r.overlap_pct == 50.0


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path):
    tables = vs.VersionedTables(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([("a", 1, "x")], "k string, at int, v string")
    assert tables.current() == 0 and tables.commit({"t": one}) == 1
    pinned = tables.read("t")
    tables.stage({"t": spark.createDataFrame([("z", 9, "lost")], one.schema)})  # dies before it publishes
    assert tables.current() == 1 and [r.v for r in tables.read("t").collect()] == ["x"]

    def broken(_):
        raise RuntimeError("killed")

    bad = one.rdd.map(broken).toDF(one.schema)
    with pytest.raises(Exception):
        tables.commit({"t": bad})
    assert tables.current() == 1 and tables.read("t").count() == 1
    assert tables.upsert("t", spark.createDataFrame([("a", 2, "new"), ("b", 1, "y")], one.schema), ["k"], "at") == 2
    assert sorted(r.v for r in tables.read("t").collect()) == ["new", "y"] and [r.v for r in pinned.collect()] == ["x"] and [r.v for r in tables.read("t", 1).collect()] == ["x"]


def test_of_two_writers_one_wins(spark, tmp_path):
    tables = vs.VersionedTables(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1,)], "v int")
    now = tables.current()
    first, second = tables.stage({"t": df}), tables.stage({"t": df.withColumn("v", F.lit(2))})
    assert tables.publish(second, now) == 1
    with pytest.raises(vs.VersionConflict):
        tables.publish(first, now)
    assert tables.read("t").first().v == 2 and tables.publish(first, 1) == 2


def test_version_manifests_find_changed_files(spark, tmp_path):
    tables = vs.VersionedTables(spark, str(tmp_path / "t"))
    tables.commit({"a": spark.range(10).coalesce(1), "b": spark.range(3).coalesce(1)})
    assert sorted(r.rows for r in tables.manifest().collect()) == [3, 10] and tables.faults().count() == 0
    path = next((tmp_path / "t/data").glob("*/b/*.parquet"))
    path.write_bytes(path.read_bytes() + b"x")
    next((tmp_path / "t/data").glob("*/a/*.parquet")).unlink()
    assert sorted(r.verdict for r in tables.faults().collect()) == ["hash_mismatch", "missing_file"]


def test_cache_never_holds_unknown_dates(spark, tmp_path):
    tables = vs.VersionedTables(spark, str(tmp_path / "t"))
    row = lambda d, at: spark.createDataFrame([("A", "s", d, pd.Timestamp(at).to_pydatetime())], "ticker string, source string, next_earnings string, fetched_at timestamp").withColumn("next_earnings", F.to_date("next_earnings"))
    vs.put_earnings(tables, row("2024-05-01", "2024-01-01 10:00"))
    vs.put_earnings(tables, row(None, "2024-01-02 10:00"))
    kept = tables.read("earnings")
    assert [str(r.next_earnings) for r in kept.collect()] == ["2024-05-01"]
    assert tb.fresh_earnings(kept, "2024-01-02 09:00").count() == 1 and tb.fresh_earnings(kept, "2024-01-02 11:00").count() == 0


def test_ticker_checks(spark):
    t = lambda n: pd.Timestamp(f"2024-01-{n:02d}").to_pydatetime()
    nan, inf = float("nan"), float("inf")
    rows = [("a", t(i), 1.0, 2.0, 1.0, 1.5, 10.0, 1) for i in range(1, 9)]
    rows += [("a", t(3), 9.0, 9.0, 9.0, 9.0, 9.0, 0), ("a", t(9), 1.0, 0.5, 1.0, 1.0, 1.0, 1), ("a", t(10), 0.0, 2.0, 0.0, 1.0, 1.0, 1), ("a", t(11), 1.0, 2.0, 1.0, 1.0, -1.0, 1)]
    rows += [("a", t(12), nan, 2.0, 1.0, None, 1.0, 1), ("a", t(13), 1.0, inf, 1.0, 1.0, 1.0, 1), ("a", t(30), 1.0, 2.0, 1.0, 1.0, 1.0, 1), ("b", t(30), 1.0, 2.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume double, arrival int")
    got = {r.ticker: r for r in fd.ticker_checks(df, "2024-01-01", "2024-01-20", 5, 3).collect()}
    a = got["a"]
    assert (a.duplicate_timestamps, a.bars_outside_range, a.missing_required_values, a.invalid_ohlc_rows, a.bars, a.complete_lookbacks, a.complete_forward_bars) == (1, 1, 2, 5, 8, 4, 5)
    assert (got["b"].bars, got["b"].complete_lookbacks, got["b"].bars_outside_range) == (0, 0, 1)
