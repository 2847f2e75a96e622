"""Landed files, feeds against the grid and versioned tables."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions import returns as rt
from barloom.operators import calendar as cal
from barloom.plans import alerts as al
from barloom.plans import datasets as ds
from barloom.plans import feeds as fd
from barloom.plans import history as hs
from barloom.session import checkpoint_dir, settle
from barloom.sinks import tables as tb
from barloom.sinks import versions as vs
from barloom.sources import bars as src
from barloom.sources import landed as ld
from oracle.sql import DAILY, day, event_bars, r, with_

from .base import query, tidy
from .datasets import thinned
from .market import SESSIONS, event_calendar

PLAIN = lambda sql: with_(select=sql).replace("WITH RECURSIVE \n", "")
MONTH = "strftime(ts, '%Y-%m')"


def scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/barloom-{name}-{uuid.uuid4().hex}"


def part_brands(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").groupBy(F.col("p_brand").alias("symbol")).agg(
        F.count(F.lit(1)).alias("members"), F.min("p_type").alias("security_type"))


# ---- symbol-months -------------------------------------------------------------------------------

@query(
    "eligible_symbol_months",
    with_(DAILY, f"""
sm AS (SELECT ticker, {MONTH} AS m, count(*) AS n, min(ts) AS a, max(ts) AS z, sum(volume) AS v FROM bars GROUP BY 1, 2),
un AS (SELECT p_brand AS ticker, count(*) AS members, min(p_type) AS t FROM part GROUP BY 1)""",
        select=f"SELECT m AS effective_month, ticker AS symbol, t AS security_type, n AS rows, {day('a')} AS start, {day('z')} AS end, {r('v', 2)} AS volume FROM sm JOIN un USING (ticker) WHERE n >= 12 AND members >= 70 AND m >= '1995-01'".replace("AS end,", 'AS "end",').replace("AS rows,", 'AS "rows",')),
)
def _(spark, sf):
    """Bars of symbol-months that are landed, of good quality and in the universe; other partitions are not read."""
    where = scratch(spark, "months")
    tb.write_symbol_months(src.daily_bars(spark, sf), where)
    files = tb.symbol_month_stats(spark, where)
    quality = files.select("effective_month", "symbol", (F.col("rows") >= 12).alias("usable"))
    universe = files.select("effective_month", "symbol").filter("effective_month >= '1995-01'").join(part_brands(spark, sf).filter("members >= 70").drop("members"), "symbol")
    bars = ld.read_eligible_months(spark, where, settle(ld.eligible_months(files, quality, universe)).filter("security_type IS NOT NULL"))
    return tidy(bars.groupBy("effective_month", "symbol", "security_type").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.sum("volume").alias("volume")), 2)


# ---- manifests -----------------------------------------------------------------------------------
CSV = "ts timestamp, open double, high double, low double, close double, volume double"
FAULTS = {"Brand-11": "hash_mismatch", "Brand-12": "row_mismatch", "Brand-13": "unlisted_file"}


def landed_csv(spark, sf):
    """Daily bars as one CSV file per ticker with their manifest, in which some entries are wrong."""
    where = scratch(spark, "csv")
    bars = settle(src.daily_bars(spark, sf).withColumn("ticker", F.replace("ticker", F.lit("#"), F.lit("-"))))
    bars.repartition("ticker").write.partitionBy("ticker").option("header", True).csv(where)
    ticker = F.regexp_extract("relative_path", "ticker=([^/]+)/", 1)
    true = ld.hashed_files(ld.present_files(spark, where, "*.csv"), where).withColumn("ticker", ticker)
    listed = true.join(bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")), "ticker").filter("ticker <> 'Brand-13'").select(
        "relative_path", F.when(F.col("ticker") == "Brand-11", F.lit("stale")).otherwise(F.col("sha256")).alias("sha256"),
        (F.col("rows") + F.when(F.col("ticker") == "Brand-12", 1).otherwise(0)).alias("rows"))
    wrong = spark.createDataFrame([("ticker=gone/a.csv", "x", 1), ("../other/b.csv", "x", 1), ("/etc/c.csv", "x", 1)], "relative_path string, sha256 string, rows bigint")
    return where, settle(listed.unionByName(wrong))


VERDICT = "CASE t WHEN 'Brand-11' THEN 'hash_mismatch' WHEN 'Brand-12' THEN 'row_mismatch' WHEN 'Brand-13' THEN 'unlisted_file' ELSE 'ok' END"


@query(
    "manifest_bars",
    with_(DAILY, "tb AS (SELECT replace(ticker, '#', '-') AS t, * FROM bars)", select=f"SELECT t AS ticker, count(*) AS bars, {r('sum(close)', 3)} AS close_sum, {day('min(ts)')} AS first_day FROM tb WHERE {VERDICT} = 'ok' GROUP BY 1"),
)
def _(spark, sf):
    """Bars of the files that the manifest vouches for."""
    where, manifest = landed_csv(spark, sf)
    bars, _ = ld.read_manifest_bars(spark, where, manifest, CSV)
    ticker = F.regexp_extract("relative_path", "ticker=([^/]+)/", 1)
    return tidy(bars.groupBy(ticker.alias("ticker")).agg(F.count(F.lit(1)).alias("bars"), F.sum("close").alias("close_sum"), F.min("ts").alias("first_day")), 3)


@query(
    "manifest_integrity",
    with_(DAILY, "tb AS (SELECT DISTINCT replace(ticker, '#', '-') AS t FROM bars)", select=f"""
SELECT t AS name, {VERDICT} AS verdict, t NOT IN ('Brand-11', 'Brand-12', 'Brand-13') AS usable FROM tb
UNION ALL SELECT * FROM (VALUES ('ticker=gone/a.csv', 'missing_file', false), ('../other/b.csv', 'path_escape', false), ('/etc/c.csv', 'path_escape', false))"""),
)
def _(spark, sf):
    """The verdict of every listed or present file: hashes read in chunks, row counts while reading."""
    where, manifest = landed_csv(spark, sf)
    verdicts = ld.read_manifest_bars(spark, where, manifest, CSV)[1]
    inside = F.regexp_extract("relative_path", "ticker=(Brand[^/]+)/", 1)
    return verdicts.select(F.when(inside != "", inside).otherwise(F.col("relative_path")).alias("name"), "verdict", (F.col("verdict") == "ok").alias("usable"))


# ---- nested records ------------------------------------------------------------------------------

@query(
    "reference_snapshot",
    PLAIN("""
SELECT '2024-01-31' AS pit_date, CASE WHEN p_size % 3 = 0 THEN 'inactive' ELSE 'active' END AS state, p_brand AS primary_exchange, count(*) AS securities, count(DISTINCT p_type) AS types, min(p_name) AS first_name, (SELECT count(*) FROM (SELECT DISTINCT p_partkey // 50 AS g, p_size % 3 = 0 AS s FROM part) WHERE g % 7 = 3) AS bad_records
FROM part WHERE (p_partkey // 50) % 7 <> 3 GROUP BY 2, 3"""),
)
def _(spark, sf):
    """Securities of landed snapshots by state and exchange; documents that do not parse are counted."""
    where = scratch(spark, "snapshots")
    p = spark.read.parquet(f"{sf}/part.parquet")
    row = F.struct(F.concat(F.lit("S"), "p_partkey").alias("ticker"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.lit("stocks").alias("market"), F.col("p_brand").alias("primary_exchange"), F.lit("2020-01-02").alias("list_date"))
    state = F.when(F.col("p_size") % 3 == 0, "inactive").otherwise("active")
    docs = p.groupBy(F.floor(F.col("p_partkey") / 50).alias("g"), state.alias("state")).agg(F.collect_list(row).alias("rows"))  # fifty parts a document
    text = F.to_json(F.struct(F.lit("2024-01-31").alias("pit_date"), "state", F.sha2(F.col("g").cast("string"), 256).alias("raw_sha256"), "rows"))
    docs.select(F.when(F.col("g") % 7 == 3, F.substring(text, 1, 60)).otherwise(text).alias("value")).write.text(where)
    records = settle(ld.read_json_records(spark, where, ld.SNAPSHOT))
    bad = records.agg(F.count("_corrupt").alias("bad_records"))
    found = ld.snapshot_rows(records).groupBy("pit_date", "state", "primary_exchange").agg(F.count(F.lit(1)).alias("securities"), F.count_distinct("type").alias("types"), F.min("name").alias("first_name"))
    return tidy(found.crossJoin(F.broadcast(bad)))


@query(
    "facts_exploded",
    PLAIN(f"""
SELECT o_orderpriority AS concept, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'shares' END AS unit, count(*) AS entries, count(DISTINCT o_custkey) AS keys, {r('sum(o_totalprice)', 1)} AS value_sum, {day('min(o_orderdate)')} AS first_end, {day('max(o_orderdate + INTERVAL 30 DAY)')} AS last_filed,
  (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 11 = 5) AS bad_records FROM orders WHERE o_custkey % 11 <> 5 GROUP BY 1, 2"""),
)
def _(spark, sf):
    """Nested facts by concept and unit; documents that do not parse are counted."""
    where = scratch(spark, "facts")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    d = F.col("o_orderdate")
    entry = F.struct(F.date_format(d, "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"), F.lit("10-K").alias("form"), F.date_format(F.date_add(F.to_date(d), 30), "yyyy-MM-dd").alias("filed"))
    unit = F.when(F.col("o_orderkey") % 2 == 0, "USD").otherwise("shares")
    by_unit = o.groupBy("o_custkey", "o_orderpriority", unit.alias("unit")).agg(F.collect_list(entry).alias("entries"))  # the orders of one customer
    by_concept = by_unit.groupBy("o_custkey", "o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("unit", "entries"))).alias("units"))
    docs = by_concept.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", F.struct(F.lower("o_orderpriority").alias("label"), "units")))).alias("facts"))
    text = F.to_json(F.struct(F.col("o_custkey").alias("key"), "facts"))
    docs.select(F.when(F.col("o_custkey") % 11 == 5, F.concat(F.substring(text, 1, 40), F.lit("{"))).otherwise(text).alias("value")).write.text(where)
    records = settle(ld.read_json_records(spark, where, ld.FACTS))
    bad = records.agg(F.count("_corrupt").alias("bad_records"))
    found = ld.fact_rows(records).groupBy("concept", "unit").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("key").alias("keys"), F.sum("value").alias("value_sum"), F.min("period_end").alias("first_end"), F.max("filed").alias("last_filed"))
    return tidy(found.crossJoin(F.broadcast(bad)), 1)


# Fixed values of the test universe: lists by sector.
LISTS = {"AUTOMOBILE": "autos", "BUILDING": "builders", "FURNITURE": "home", "MACHINERY": "industrial"}
LIST_SQL = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'autos' WHEN 'BUILDING' THEN 'builders' WHEN 'FURNITURE' THEN 'home' WHEN 'MACHINERY' THEN 'industrial' END"


@query("index_constituents", PLAIN(f"SELECT 'C-' || c_custkey || '-B' AS symbol, c_mktsegment AS sector, {LIST_SQL} AS list_key FROM customer"))
def _(spark, sf):
    """Index members with cleaned symbols and the list of their sector."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return ld.constituents(c.select(F.concat(F.lit(" c."), "c_custkey", F.lit(".b ")).alias("symbol"), F.col("c_mktsegment").alias("sector")), LISTS)


@query("universe_counts", PLAIN(f"SELECT c_mktsegment AS sector, {LIST_SQL} AS list_key, count(*) AS members, count(DISTINCT c_nationkey) AS nations, min('C-' || c_custkey || '-B') AS first_symbol FROM customer GROUP BY 1, 2"))
def _(spark, sf):
    """Members of every sector and its list."""
    c = spark.read.parquet(f"{sf}/customer.parquet")
    m = ld.constituents(c.select(F.concat(F.lit(" c."), "c_custkey", F.lit(".b ")).alias("symbol"), F.col("c_mktsegment").alias("sector"), "c_nationkey"), LISTS)
    keyed = c.select(F.concat(F.lit("C-"), "c_custkey", F.lit("-B")).alias("symbol"), "c_nationkey")
    return m.join(keyed, "symbol").groupBy("sector", "list_key").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("c_nationkey").alias("nations"), F.min("symbol").alias("first_symbol"))


# ---- feeds ---------------------------------------------------------------------------------------

def asked_series(spark, bars):
    """What both feeds are asked for: the days of the table's span, and one series that no feed has."""
    span = bars.agg(F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day"))
    names = bars.select("ticker").distinct().unionByName(spark.createDataFrame([("none",)], "ticker string"))
    return settle(names.crossJoin(F.broadcast(span)))


COVER = f"""
{event_bars(60, "raw")},
span AS (SELECT min(ts)::DATE AS a, max(ts)::DATE AS z FROM raw),
bars AS MATERIALIZED (SELECT * FROM raw),
{SESSIONS},
grid AS MATERIALIZED (SELECT d, unnest(generate_series(opens, closes - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM sess WHERE NOT early AND d BETWEEN (SELECT a FROM span) AND (SELECT z FROM span)),
ask AS (SELECT DISTINCT ticker FROM raw UNION ALL SELECT 'none')"""
SHIFTED = "ts + INTERVAL 30 MINUTE"  # hourly bars moved onto the half hour, where sessions open


@query(
    "feed_coverage",
    with_(COVER, f"""
fb AS (SELECT ticker, ts + INTERVAL 30 MINUTE AS ts, volume FROM raw WHERE NOT (ticker = 'view' AND hour(ts) = 15 AND day(ts) % 4 = 0) AND NOT (ticker = 'click' AND day(ts) = 10)
  UNION ALL SELECT ticker, ts + INTERVAL 40 MINUTE, volume FROM raw WHERE ticker = 'error' AND hour(ts) = 16),
cl AS (SELECT b.*, s.d, CASE WHEN s.d IS NULL OR b.ts < opens OR b.ts >= closes THEN 'extended' WHEN (epoch(b.ts) - epoch(opens)) % 3600 <> 0 OR b.ts + INTERVAL 1 HOUR > closes THEN 'off_grid' WHEN early THEN 'early_close' ELSE 'primary' END AS class
  FROM (SELECT *, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS ld FROM fb) b LEFT JOIN sess s ON s.d = b.ld WHERE b.ld BETWEEN (SELECT a FROM span) AND (SELECT z FROM span)),
ct AS (SELECT ticker, count(*) * 2 AS raw, count(*) AS n, count(*) FILTER (class = 'primary') AS p, count(*) FILTER (class = 'early_close') AS e, count(*) FILTER (class = 'extended') AS x, count(*) FILTER (class = 'off_grid') AS o, list(DISTINCT d) FILTER (class = 'primary') AS seen FROM cl GROUP BY 1)""",
        select=f"""
SELECT ticker, (SELECT count(*) FROM grid) AS expected_bars, coalesce(raw, 0) AS raw_rows, coalesce(n, 0) AS duplicate_timestamps, 0::BIGINT AS zero_volume_bars, coalesce(p, 0) AS primary_bars, coalesce(e, 0) AS early_close_bars, coalesce(x, 0) AS extended_bars, coalesce(o, 0) AS off_grid_bars, 0::BIGINT AS invalid_primary_bars,
  (SELECT count(*) FROM grid) - coalesce(p, 0) AS missing_bars, {r('coalesce(p, 0) * 100e0 / (SELECT count(*) FROM grid)')} AS coverage_pct, CASE WHEN p > 0 THEN 100e0 ELSE 0e0 END AS duplicate_rate_pct, 0e0 AS zero_volume_rate_pct,
  coalesce((SELECT string_agg({day('g.d')}, '|' ORDER BY g.d) FROM (SELECT DISTINCT d FROM grid) g WHERE NOT coalesce(list_contains(seen, g.d), false)), '') AS missing_sessions, 'failed' AS threshold_result FROM ask LEFT JOIN ct USING (ticker)"""),
)
def _(spark, sf):
    """A feed with planted gaps, off-grid bars and every bar sent twice, against the grid it should cover."""
    raw = settle(src.event_bars(spark, sf, 60))
    later = lambda df, m: df.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + m * 60))
    gaps = ((F.col("ticker") == "view") & (F.hour("ts") == 15) & (F.dayofmonth("ts") % 4 == 0)) | ((F.col("ticker") == "click") & (F.dayofmonth("ts") == 10))
    feed = later(raw.filter(~gaps), 30).unionByName(later(raw.filter("ticker = 'error' AND hour(ts) = 16"), 40))
    sessions = settle(event_calendar(raw))
    return tidy(fd.feed_coverage(settle(feed.unionByName(feed)), asked_series(spark, raw), sessions, cal.session_grid(sessions, 60), 60))


@query(
    "feed_grid_comparison",
    with_(COVER, f"""
{event_bars(60, "thin").replace("FROM events GROUP BY", "FROM events WHERE event_id % 7 <> 0 GROUP BY")},
fa AS (SELECT * REPLACE (ts + INTERVAL 30 MINUTE AS ts) FROM raw WHERE ticker <> 'purchase'), fb AS (SELECT * REPLACE (ts + INTERVAL 30 MINUTE AS ts) FROM thin WHERE ticker <> 'signup' UNION ALL SELECT * REPLACE (ts + INTERVAL 30 MINUTE AS ts) FROM raw WHERE ticker = 'signup'),
jj AS MATERIALIZED (
  SELECT k.ticker, g.ts, a.close IS NOT NULL AND b.close IS NOT NULL AS paired, a.volume AS av, b.volume AS bv,
    abs(a.open - b.open) > 1e-8 + 1e-5 * abs(b.open) OR abs(a.high - b.high) > 1e-8 + 1e-5 * abs(b.high) OR abs(a.low - b.low) > 1e-8 + 1e-5 * abs(b.low) OR abs(a.close - b.close) > 1e-8 + 1e-5 * abs(b.close) AS off
  FROM ask k CROSS JOIN grid g LEFT JOIN fa a ON a.ticker = k.ticker AND a.ts = g.ts LEFT JOIN fb b ON b.ticker = k.ticker AND b.ts = g.ts),
gc AS (SELECT ticker, count(*) AS e, count(*) FILTER (paired) AS p, count(*) FILTER (paired AND off) AS o, sum(av) FILTER (paired) AS av, sum(bv) FILTER (paired) AS bv, median(bv / av) FILTER (paired AND av > 0) AS mr FROM jj GROUP BY 1),
sz AS (SELECT ticker, (SELECT count(*) FROM fa WHERE fa.ticker = k.ticker) AS a_bars, (SELECT count(*) FROM fb WHERE fb.ticker = k.ticker) AS b_bars FROM ask k)""",
        select=f"""
SELECT ticker, e AS expected_bars, p AS paired_bars, o AS ohlc_differences, av AS a_volume, bv AS b_volume, {r('mr')} AS median_volume_ratio, a_bars, b_bars, {r('p * 100e0 / e')} AS overlap_pct, {r('bv / av')} AS volume_ratio,
  CASE WHEN a_bars = 0 AND b_bars = 0 THEN 'not_comparable' WHEN a_bars = 0 OR b_bars = 0 THEN 'one_feed_empty' WHEN p = 0 THEN 'no_overlap' WHEN o = 0 AND round(bv / av, 6) = 1 THEN 'identical' WHEN o = 0 THEN 'same_timestamps_different_values' ELSE 'different_ohlc' END AS classification
FROM gc JOIN sz USING (ticker)"""),
)
def _(spark, sf):
    """Two feeds re-indexed on the expected grid: one equal series, one that a feed lacks, one that both lack."""
    raw = settle(src.event_bars(spark, sf, 60))
    later = lambda df: settle(df.withColumn("ts", F.timestamp_seconds(F.unix_seconds("ts") + 1800)))
    a = later(raw.filter("ticker <> 'purchase'"))
    b = later(thinned(spark, sf).filter("ticker <> 'signup'").unionByName(raw.filter("ticker = 'signup'")))
    return tidy(fd.feed_grid_comparison(a, b, asked_series(spark, raw), cal.session_grid(event_calendar(raw), 60)))


# ---- versioned tables ----------------------------------------------------------------------------

@query(
    "snapshot_commit",
    with_(DAILY, f"""
fl AS (SELECT *, ticker = 'Brand#21' OR (ticker = 'Brand#22' AND month(ts) = 3) AS bad FROM bars)""",
        select="SELECT 'bars' AS \"table\", count(*) AS \"rows\", 0::BIGINT AS faults, 2::BIGINT AS version FROM fl WHERE NOT bad AND ticker NOT IN ('Brand#21') UNION ALL SELECT 'removed', count(*), 0, 2 FROM fl WHERE bad UNION ALL SELECT 'quality', count(DISTINCT ticker), 0, 2 FROM fl UNION ALL SELECT 'audit', 1, 0, 2"),
)
def _(spark, sf):
    """Cleaned bars, removed rows, quality and audit as one version; rows by its manifest, faults by its hashes."""
    tables = vs.VersionedTables(spark, scratch(spark, "snapshot"))
    bad = (F.col("ticker") == "Brand#21") | ((F.col("ticker") == "Brand#22") & (F.month("ts") == 3))
    flagged = settle(src.daily_bars(spark, sf).withColumn("reason_codes", F.when(bad, F.array(F.lit("planted"))).otherwise(F.array().cast("array<string>"))))
    quality = flagged.groupBy("ticker").agg(F.when(F.count_if(F.size("reason_codes") == 0) > 0, "pass").otherwise("fail").alias("status"))
    audit = flagged.agg(F.count(F.lit(1)).alias("rows"))
    vs.commit_snapshot(tables, flagged.limit(0), quality, audit)
    version = vs.commit_snapshot(tables, flagged, quality, audit)
    rows = tables.manifest(version).groupBy(F.substring_index("relative_path", "/", 1).alias("table")).agg(F.sum("rows").alias("rows"))
    faults = tables.faults(version).agg(F.count(F.lit(1)).alias("faults"))
    return rows.crossJoin(F.broadcast(faults)).withColumn("version", F.lit(version).cast("bigint"))


@query(
    "outcomes_marked",
    PLAIN(f"SELECT o_orderkey AS id, {r('round_even(o_totalprice / 100 * 1e4, 0) / 1e4')} AS outcome_close, {r('round_even((o_custkey % 41 - 20) / 7e0 * 1e2, 0) / 1e2')} AS outcome_pct, CASE WHEN o_orderkey % 3 <> 0 THEN 'p2' END AS outcome_provider FROM orders".replace("round_even(o_totalprice / 100 * 1e4, 0) / 1e4", "CASE WHEN o_orderkey % 3 <> 0 THEN round_even(o_totalprice / 100 * 1e4, 0) / 1e4 END").replace("round_even((o_custkey % 41 - 20) / 7e0 * 1e2, 0) / 1e2", "CASE WHEN o_orderkey % 3 <> 0 THEN round_even((o_custkey % 41 - 20) / 7e0 * 1e2, 0) / 1e2 END")),
)
def _(spark, sf):
    """Outcomes written back in two passes; signals show the newest."""
    where = scratch(spark, "outcomes")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    found = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 100).alias("outcome_close"), ((F.col("o_custkey") % 41 - 20) / 7.0).alias("outcome_pct"))
    tb.mark_outcomes(found.withColumn("outcome_close", F.col("outcome_close") + 1), where, "p1")
    tb.mark_outcomes(found, where, "p2")
    return tidy(hs.with_outcomes(o.select(F.col("o_orderkey").alias("id")), spark.read.parquet(where)))


@query(
    "earnings_cache_put",
    PLAIN(f"""
SELECT ticker, source, {day('arg_max(nxt, t)')} AS next_earnings, {day('max(t)')} AS fetched_at FROM (
  SELECT 'C' || o_custkey AS ticker, o_orderpriority AS source, o_orderdate + to_seconds(o_orderkey % 86400) AS t, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderdate + to_days((o_orderkey % 30)::INT))::DATE END AS nxt FROM orders) WHERE nxt IS NOT NULL GROUP BY 1, 2"""),
)
def _(spark, sf):
    """Three puts into a versioned cache, the newest fetch per key staying."""
    tables = vs.VersionedTables(spark, scratch(spark, "cache"))
    o = spark.read.parquet(f"{sf}/orders.parquet")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86_400)
    date = F.when(F.col("o_orderkey") % 4 != 0, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 30).cast("int")))
    fetched = o.select(F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.col("o_orderpriority").alias("source"), date.alias("next_earnings"), at.alias("fetched_at"))
    once = fetched.groupBy("ticker", "source", (F.hour("fetched_at") % 3).alias("turn")).agg(F.max_by("next_earnings", F.when(F.col("next_earnings").isNotNull(), F.col("fetched_at"))).alias("next_earnings"), F.max(F.when(F.col("next_earnings").isNotNull(), F.col("fetched_at"))).alias("fetched_at"))
    for turn in range(3):
        vs.put_earnings(tables, once.filter(F.col("turn") == turn).drop("turn"))
    return tidy(tables.read("earnings"))


@query(
    "timeframe_parity",
    with_(event_bars(60), SESSIONS, f"""
td AS (SELECT event_type AS ticker, s.d, event_id, e.ts, value FROM events e JOIN sess s ON e.ts >= opens AND e.ts < closes),
ref AS (SELECT ticker, d, last(value ORDER BY ts, event_id) AS c, count(*)::DOUBLE AS v FROM td GROUP BY 1, 2),
oth AS (SELECT ticker, d, last(value ORDER BY ts, event_id) AS c, count(*)::DOUBLE AS v FROM td WHERE NOT (ticker = 'view' AND event_id % 7 = 0) AND NOT (ticker = 'click' AND day(d) = 9) GROUP BY 1, 2)""",
        select=f"""
SELECT ticker, {day('d')} AS session_date, {r('abs(o.c - r.c) / greatest(r.c, 1e-9) * 100')} AS close_diff_pct, {r('abs(o.v - r.v) / greatest(r.v, 1e-9) * 100')} AS volume_diff_pct,
  CASE WHEN o.c IS NULL THEN 'missing' WHEN abs(o.c - r.c) / greatest(r.c, 1e-9) * 100 > 0.5 OR abs(o.v - r.v) / greatest(r.v, 1e-9) * 100 > 0.5 THEN 'mismatch' ELSE 'ok' END AS verdict FROM ref r LEFT JOIN oth o USING (ticker, d)"""),
)
def _(spark, sf):
    """Half-hour bars summed up to sessions against five-minute bars, one series thinned and one with a day missing."""
    fine = settle(src.event_bars(spark, sf, 5))
    ev = spark.read.parquet(f"{sf}/events.parquet")
    t = F.col("ts").cast("timestamp")
    day_of = F.dayofmonth(F.from_utc_timestamp(t, cal.ZONE))
    some = ev.filter(~((F.col("event_type") == "view") & (F.col("event_id") % 7 == 0)) & ~((F.col("event_type") == "click") & (day_of == 9)))
    start = F.timestamp_seconds(F.floor(F.unix_seconds(t) / 1800) * 1800)
    ticks = some.select(F.col("event_type").alias("ticker"), start.alias("bar_ts"), F.unix_micros(t).alias("us"), "event_id", F.col("value").alias("price"), F.lit(1.0).alias("quantity"))
    coarse = src.ticks_to_bars(ticks, ["ticker", "bar_ts"], src.wide_order(F.col("us") - F.unix_micros("bar_ts"), F.col("event_id"))).withColumnRenamed("bar_ts", "ts")
    return tidy(fd.timeframe_parity(coarse, fine, event_calendar(src.event_bars(spark, sf, 60)), 0.5))


@query(
    "pattern_snapshot_check",
    with_(DAILY, """
pl AS (SELECT *, ts::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AS inside, day(ts) = 11 AS gone, day(ts) = 13 AS broken FROM bars),
ck AS (SELECT ticker, count(*) FILTER (day(ts) = 7) AS dup, count(*) FILTER (NOT inside) AS outside, count(*) FILTER (inside AND gone) AS missing, count(*) FILTER (inside AND (gone OR broken)) AS invalid, count(*) FILTER (inside AND NOT gone AND NOT broken) AS n FROM pl GROUP BY 1)""",
        select="SELECT ticker, dup AS duplicate_timestamps, outside AS bars_outside_range, missing AS missing_required_values, invalid AS invalid_ohlc_rows, n AS bars, greatest(0, n - 9) AS complete_lookbacks, greatest(0, n - 5) AS complete_forward_bars FROM ck"),
)
def _(spark, sf):
    """Ticker checks of a snapshot with repeated, missing and broken rows."""
    d = F.dayofmonth("ts")
    bars = src.daily_bars(spark, sf).withColumns({"close": F.when(d != 11, F.col("close")), "high": F.when(d == 13, F.col("low") / 2).otherwise(F.col("high")), "arrival": F.lit(1)})
    twice = bars.filter(d == 7).withColumns({"arrival": F.lit(0), "close": F.lit(None).cast("double")})
    return tidy(fd.ticker_checks(bars.unionByName(twice), "1995-01-01", "1996-12-31", 10, 5))


# ---- functions over whole tables -----------------------------------------------------------------

@query(
    "timestamp_verdict",
    with_(event_bars(60), SESSIONS, """
v AS (SELECT ticker, s.d, count(*) FILTER (epoch(ts - opens)::BIGINT % 3600 = 0) AS g, bool_or(ts = opens) AS o, bool_or(ts = closes) AS c FROM bars JOIN sess s ON ts BETWEEN opens AND closes AND NOT early GROUP BY 1, 2),
w AS (SELECT ticker, CASE WHEN g < 5 THEN 'undetermined' WHEN o AND NOT c THEN 'bar_start' WHEN c AND NOT o THEN 'bar_end' ELSE 'ambiguous' END AS vote FROM v)""",
        select="""SELECT ticker, CASE WHEN bool_and(vote = 'bar_start') THEN 'bar_start' WHEN bool_and(vote = 'bar_end') THEN 'bar_end' WHEN bool_or(vote = 'ambiguous') OR (bool_or(vote = 'bar_start') AND bool_or(vote = 'bar_end')) THEN 'ambiguous' ELSE 'undetermined' END AS semantics FROM w GROUP BY 1"""),
)
def _(spark, sf):
    """Whether a feed stamps bars at their start or end, from all its sessions' votes."""
    bars = src.event_bars(spark, sf, 60)
    return ds.timestamp_verdict(ds.timestamp_votes(bars, event_calendar(bars), 60))


@query(
    "bar_history",
    with_(DAILY, select=f"SELECT ticker, {day('ts')} AS ts, {r('CASE WHEN month(ts) <> 5 THEN close END')} AS close, {r('volume', 1)} AS volume FROM bars WHERE ts BETWEEN TIMESTAMP '1994-02-01' AND TIMESTAMP '1995-03-31' AND day(ts) <> 20"),
)
def _(spark, sf):
    """Bars of a span, the last version of each; rows that lack all figures go, rows that lack the close stay."""
    bars = src.daily_bars(spark, sf).withColumn("arrival", F.lit(1))
    none = {c: F.when(F.dayofmonth("ts") != 20, F.col(c)) for c in ("open", "high", "low", "close", "volume")}
    last = bars.withColumns(none).withColumn("close", F.when(F.month("ts") != 5, F.col("close")))
    first = bars.filter(F.dayofmonth("ts") != 20).withColumns({"arrival": F.lit(0), "close": F.lit(-1.0)})
    return tidy(src.daily_history(last.unionByName(first), "1994-02-01", "1995-03-31", "arrival").select("ticker", "ts", "close", "volume"))


FILL = "l_extendedprice / l_quantity"


@query("additive_fills", PLAIN(f"SELECT l_orderkey AS id, l_linenumber AS line, {r(f'{FILL} * (1 + 7.5e-4)')} AS entry_fill, {r(f'{FILL} * (1 - 7.5e-4)')} AS exit_fill FROM lineitem"))
def _(spark, sf):
    """Fills of every line with slippage and commission added up."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return tidy(li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), rt.additive_entry_fill(price, 5.0, 2.5).alias("entry_fill"), rt.additive_exit_fill(price, 5.0, 2.5).alias("exit_fill")))


@query("payload_hashes", PLAIN("SELECT p_partkey AS id, sha256(p_name || '|' || p_brand || '|' || p_size) AS payload_sha256 FROM part"))
def _(spark, sf):
    """The hash by which an alert's payload is known."""
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("size_text", F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), al.payload_hash("p_name", "p_brand", "size_text").alias("payload_sha256"))


@query("signal_providers", PLAIN("SELECT o_orderpriority AS timeframe, count(DISTINCT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderstatus END) AS providers, count(*) FILTER (o_orderkey % 50 = 0) AS missing, false AS valid FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 UNION ALL SELECT 'F', 1, 0, true"))
def _(spark, sf):
    """Whether a frame of signals comes from one provider: a mixed one with gaps, and one that does."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    mixed = o.filter("o_orderpriority = '1-URGENT'").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderstatus")).alias("provider"))
    one = o.filter("o_orderstatus = 'F'").select(F.col("o_orderstatus").alias("provider"))
    return hs.single_provider(mixed).withColumn("timeframe", F.lit("1-URGENT")).unionByName(hs.single_provider(one).withColumn("timeframe", F.lit("F")))
