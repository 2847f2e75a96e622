"""Securities, universe, symbol-month quality, feeds, manifests and facts."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import calendar as cal
from barloom.operators import quality as q
from barloom.plans import datasets as ds
from barloom.plans import intraday as it
from barloom.sources import bars as src
from oracle.sql import DAILY, day, event_bars, r, with_

from .base import query, tidy
from .bars import FAULTY, faulty_bars
from .market import LOCAL, SESSIONS, event_calendar

PART_LISTING = """
sec AS MATERIALIZED (SELECT upper(trim(CASE WHEN p_partkey % 97 = 0 THEN '' ELSE p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_partkey::VARCHAR END END)) AS ticker,
  lower(p_type) AS category, CASE WHEN p_size % 11 = 0 THEN '' WHEN p_size % 2 = 0 THEN 'XNYS' ELSE 'BATS' END AS ex FROM part)"""


@query(
    "security_eligibility",
    with_(PART_LISTING, select="""
SELECT reason, count(*) AS securities FROM (
  SELECT CASE WHEN ticker = '' THEN 'blank_ticker' WHEN n > 1 THEN 'duplicate_symbol' WHEN category NOT IN ('standard', 'small', 'medium', 'large') THEN 'security_type:' || category WHEN ex = '' THEN 'missing_exchange'
    WHEN ex <> 'XNYS' THEN 'exchange_not_allowed:' || ex ELSE '' END AS reason FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM sec)) GROUP BY 1"""),
)
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    name = F.when(F.col("p_partkey") % 97 == 0, "").otherwise(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_partkey").cast("string"))))
    listing = p.select(name.alias("ticker"), F.lower("p_type").alias("category"), F.when(F.col("p_size") % 11 == 0, "").when(F.col("p_size") % 2 == 0, "XNYS").otherwise("BATS").alias("primary_exchange"))
    v = ds.eligibility_verdicts(listing, ["standard", "small", "medium", "large"], ["promo"], ["XNYS"])
    return v.groupBy("reason").agg(F.count(F.lit(1)).alias("securities"))


WORDS = ["Common Stock", "ETF", "Warrants", "Units", "Preferred", "Acquisition Corp", "closed-end fund", "plain"]


NAME_WORDS = ["inc common", "etf trust", "exchange traded note", "preferred a", "warrants", "subscription rights", "units", "closed-end", "income fund", "mutual fund inc", "acquisition corp", "shell company", "holdings", "co", "blank check inc", "reit fund group"]
TYPE_CODES = ["CS", "PFD", "WARRANT", "ETN", "ETF", "FUND", "INDEX", "ADRC", "cs", None, "BASKET"]
EXCHANGES = ["XNYS", "XNAS", "", None, "ARCX"]
MARKETS = ["stocks", "otc", "stocks", "fx"]
SICS = ["6770", "6799", "3711", None, "2834", "1311"]


def sql_list(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(
    "security_classes",
    f"""
WITH p AS (SELECT lower(p_name || ' ' || ({sql_list(NAME_WORDS)})[p_partkey % 16 + 1]) AS n, upper(coalesce(({sql_list(TYPE_CODES)})[p_partkey % 11 + 1], '')) AS k, coalesce(({sql_list(EXCHANGES)})[p_partkey // 7 % 5 + 1], '') AS x,
  ({sql_list(MARKETS)})[p_partkey // 3 % 4 + 1] AS m, coalesce(({sql_list(SICS)})[p_partkey // 5 % 6 + 1], '') AS s, CASE WHEN p_size % 17 = 0 THEN 'Blank checks' ELSE p_type END AS sd, CASE WHEN p_size % 5 = 0 THEN 'Ordinary' ELSE 'Common Stock' END AS cd FROM part),
c AS (SELECT *, regexp_matches(n, 'spac|blank check|blank-check|acquisition corp|acquisition company|hedosophia|social capital|special purpose|newmont acquisition') AS sp, n LIKE '%shell company%' OR trim(n) = 'shell' AS sh FROM p),
d AS (SELECT *, CASE WHEN regexp_matches(n, 'etf|exchange traded fund') THEN 'ETF' WHEN regexp_matches(n, 'etn|exchange traded note') THEN 'ETN' WHEN regexp_matches(n, 'preferred stock|preference share|preferred share|preferred [abcd]') THEN 'preferred_stock'
  WHEN n LIKE '%warrant%' THEN 'warrant' WHEN regexp_matches(n, ' right|rights') THEN 'right' WHEN n LIKE '%unit%' THEN 'unit' WHEN regexp_matches(n, 'closed-end|closed end|closedend|fnd') OR (n LIKE '%fund%' AND NOT regexp_matches(n, 'reit|investment trust|mutual')) THEN 'closed_end_fund'
  WHEN sp THEN 'pre_merger_spac' WHEN sh THEN 'shell_company' END AS nc FROM c)
SELECT CASE WHEN m = 'otc' OR x = '' THEN 'OTC' WHEN k IN ('PFD', 'ADRP') THEN 'preferred_stock' WHEN k IN ('WARRANT', 'ADRW') THEN 'warrant' WHEN k IN ('RIGHT', 'ADRR') THEN 'right' WHEN k = 'UNIT' THEN 'unit' WHEN k = 'ETN' THEN 'ETN'
  WHEN k IN ('BOND', 'SP', 'ADRC', 'ETV', 'BASKET') THEN 'other_structurally_incomparable_securities' WHEN s = '6770' OR lower(sd) LIKE '%blank%' OR sp THEN 'pre_merger_spac' WHEN sh OR s = '6799' THEN 'shell_company' WHEN k = 'ETF' THEN 'ETF'
  WHEN k = 'FUND' THEN CASE WHEN m = 'stocks' THEN 'closed_end_fund' ELSE 'other_structurally_incomparable_securities' END WHEN nc IS NOT NULL THEN nc
  WHEN k = 'CS' AND lower(cd) LIKE '%common stock%' AND regexp_matches(n, 'inc|corp|company|plc|ltd|limited|holdings|group|enterprises') THEN 'common_stock' ELSE 'unknown' END AS security_class, count(*) AS parts
FROM d GROUP BY 1""",
)
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    pick = lambda values, at: F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(at, F.lit(len(values))).cast("int"))
    key = F.col("p_partkey")
    whole = lambda by: F.floor(key / by)
    c = ds.security_class(
        F.concat_ws(" ", "p_name", pick(NAME_WORDS, key)), pick(TYPE_CODES, key), pick(MARKETS, whole(3)), pick(EXCHANGES, whole(7)), pick(SICS, whole(5)),
        F.when(F.col("p_size") % 17 == 0, "Blank checks").otherwise(F.col("p_type")), F.when(F.col("p_size") % 5 == 0, "Ordinary").otherwise("Common Stock"))
    return p.groupBy(c.alias("security_class")).agg(F.count(F.lit(1)).alias("parts"))


RULE = ds.UniverseRule(prior_sessions=10, min_close=500.0, min_dollar_volume=20_000.0, top_n=8)
UNIVERSE = """
sd AS MATERIALIZED (SELECT d, row_number() OVER (ORDER BY d) AS no FROM (SELECT unnest(generate_series((SELECT min(ts) FROM bars)::DATE - INTERVAL 7 DAY, (SELECT max(ts) FROM bars)::DATE + INTERVAL 7 DAY, INTERVAL 1 DAY))::DATE AS d)),
mo AS (SELECT strftime(m + INTERVAL 1 MONTH, '%Y-%m') AS effective_month, (m + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS pit FROM (SELECT DISTINCT date_trunc('month', ts) AS m FROM bars)),
wn AS (SELECT effective_month, pit, (SELECT max(no) FROM sd WHERE d <= pit) AS last FROM mo),
lq AS MATERIALIZED (SELECT effective_month, b.ticker, last(close ORDER BY b.ts) AS pc, median(close * volume) AS dv, count(*) AS n FROM wn JOIN sd ON no BETWEEN last - 9 AND last JOIN bars b ON b.ts::DATE = d GROUP BY 1, 2),
un AS (SELECT *, n >= 10 AND pc >= 500 AND dv >= 20000 AS ok, row_number() OVER (PARTITION BY effective_month, n >= 10 AND pc >= 500 AND dv >= 20000 ORDER BY dv DESC, ticker) AS rk FROM lq)"""


@query(
    "monthly_universe",
    with_(DAILY, UNIVERSE, select=f"""
SELECT effective_month, ticker, {r('pc', 3)} AS prior_close, {r('dv', 2)} AS median_dollar_volume, n AS valid_sessions, ok AND rk <= 8 AS included, CASE WHEN ok AND rk <= 8 THEN rk END AS liquidity_rank,
  CASE WHEN ok AND rk <= 8 THEN '' WHEN n < 10 THEN 'insufficient_liquidity_data' WHEN pc < 500 THEN 'below_prior_close_threshold' WHEN dv < 20000 THEN 'below_median_volume_threshold' ELSE 'not_in_top' END AS exclusion_reason FROM un"""),
)
def _(spark, sf):
    bars = src.daily_bars(spark, sf)
    sessions = cal.calendar_of(bars, trading=F.lit(True))
    m = F.date_trunc("month", "ts")
    months = bars.select(m.alias("m")).distinct().select(
        F.date_format(F.add_months("m", 1), "yyyy-MM").alias("effective_month"), F.last_day("m").alias("pit_date"))
    u = ds.monthly_universe(ds.monthly_liquidity(bars, months, sessions, RULE), RULE)
    keys = ["effective_month", "ticker"]
    return tidy(u.select(*keys, "prior_close", "valid_sessions", "included", "liquidity_rank", "exclusion_reason"), 3).join(tidy(u.select(*keys, "median_dollar_volume"), 2), keys)


QUALITY = """
xs AS MATERIALIZED (SELECT d, strftime(d, '%Y-%m') AS m FROM (SELECT unnest(generate_series((SELECT min(ts) FROM bars)::DATE - INTERVAL 7 DAY, (SELECT max(ts) FROM bars)::DATE + INTERVAL 7 DAY, INTERVAL 1 DAY))::DATE AS d) WHERE isodow(d) < 6),
mq AS MATERIALIZED (
  SELECT x.m AS effective_month, c.ticker, (SELECT count(*) FROM xs z WHERE z.m = x.m) AS expected_sessions, count(*) AS actual_sessions, count(*) FILTER (codes <> '') AS invalid_rows
  FROM coded c JOIN xs x ON x.d = c.ts::DATE GROUP BY 1, 2),
mr AS MATERIALIZED (SELECT *, (expected_sessions - actual_sessions) / expected_sessions * 100 AS missing, concat_ws('; ', CASE WHEN invalid_rows > 0 THEN 'invalid_ohlc' END, CASE WHEN (expected_sessions - actual_sessions) / expected_sessions * 100 > 30 THEN 'missing_bar_rate' END) AS reason FROM mq)"""


def rejections(spark, sf):
    bars = faulty_bars(spark, sf)
    return ds.month_rejections(ds.month_quality(bars, cal.calendar_of(bars), F.size(q.reason_codes()) > 0), max_missing=30.0)


@query("symbol_month_quality", with_(DAILY, FAULTY, QUALITY, select=f"SELECT effective_month, ticker, expected_sessions, actual_sessions, invalid_rows, {r('missing')} AS missing_rate_pct, reason AS rejection_reason FROM mr"))
def _(spark, sf):
    return tidy(rejections(spark, sf).select("effective_month", "ticker", "expected_sessions", "actual_sessions", "invalid_rows", "missing_rate_pct", "rejection_reason"))


@query(
    "monthly_rejection_summary",
    with_(DAILY, FAULTY, QUALITY, select=f"""
SELECT CASE WHEN grouping(effective_month) = 1 THEN 'total' ELSE effective_month END AS effective_month, count(*) AS total_symbols, count(*) FILTER (invalid_rows > 0) AS invalid_symbols, count(*) FILTER (invalid_rows = 0 AND reason <> '') AS quality_rejected,
  {r("count(*) FILTER (reason <> '') * 100e0 / count(*)")} AS rejected_pct, count(*) FILTER (reason <> '') * 100e0 / count(*) > 5 AS breaches FROM mr GROUP BY ROLLUP (effective_month)"""),
)
def _(spark, sf):
    return tidy(ds.monthly_summary(rejections(spark, sf)))


@query(
    "dataset_disposition",
    with_(DAILY, FAULTY, QUALITY, select="SELECT CASE WHEN bool_or(inv > 0) THEN 'invalid' WHEN bool_or(rej * 100e0 / n > 5) THEN 'inconclusive' ELSE 'valid' END AS disposition, count(*) FILTER (rej * 100e0 / n > 5) AS breached_months FROM (SELECT effective_month, count(*) AS n, count(*) FILTER (invalid_rows > 0) AS inv, count(*) FILTER (reason <> '') AS rej FROM mr GROUP BY 1)"),
)
def _(spark, sf):
    return ds.disposition(ds.monthly_summary(rejections(spark, sf)))


@query(
    "daily_bar_quality",
    with_(DAILY, FAULTY, QUALITY, "xn AS MATERIALIZED (SELECT d, row_number() OVER (ORDER BY d) AS no FROM xs)", select=f"""
SELECT ticker, count(*) AS total_bars, count(*) FILTER (codes <> '') AS malformed_count, 0::BIGINT AS duplicate_count, 0::BIGINT AS zero_volume_count, count(no) AS actual_sessions,
  {r('count(no) / (max(no) - min(no) + 1)::DOUBLE')} AS all_completeness, {r('count(*) FILTER (no > top - 252) / 252e0')} AS trailing_completeness
FROM (SELECT c.*, no, max(no) OVER (PARTITION BY ticker) AS top FROM coded c LEFT JOIN xn ON d = ts::DATE) GROUP BY ticker"""),
)
def _(spark, sf):
    bars = faulty_bars(spark, sf)
    return tidy(ds.daily_quality(bars, cal.calendar_of(bars), F.size(q.reason_codes()) > 0))


@query(
    "session_removal_classes",
    with_(event_bars(5), SESSIONS, select=f"""
SELECT ticker, CASE WHEN m < 570 THEN 'premarket' WHEN m >= 960 THEN 'after_hours' WHEN s.d IS NULL OR early THEN 'early_close_or_no_session' WHEN m % 5 <> 0 THEN 'off_grid' ELSE 'kept' END AS class, count(*) AS bars
FROM (SELECT *, hour(lt) * 60 + minute(lt) AS m FROM (SELECT *, {LOCAL} AS lt FROM bars)) b LEFT JOIN sess s ON s.d = lt::DATE GROUP BY 1, 2"""),
)
def _(spark, sf):
    bars = src.event_bars(spark, sf, 5)
    s = F.broadcast(event_calendar(bars).select("session_date", "is_early_close"))
    j = bars.withColumn("session_date", cal.local_day("ts")).join(s, "session_date", "left")
    return j.groupBy("ticker", it.removal_class(F.coalesce("is_early_close", F.lit(True))).alias("class")).agg(F.count(F.lit(1)).alias("bars"))


FEEDS = f"""
{event_bars(60, 'fa')}, {event_bars(60, 'fb').replace('FROM events', 'FROM events WHERE event_id % 7 <> 0')},
fj AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, a.open AS ao, b.open AS bo, a.high AS ah, b.high AS bh, a.low AS al, b.low AS bl, a.close AS ac, b.close AS bc, a.volume AS av, b.volume AS bv, a.ts AS ta, b.ts AS tb
  FROM fa a FULL JOIN fb b ON a.ticker = b.ticker AND a.ts = b.ts)"""
OFF = lambda c: f"count(*) FILTER (ta IS NOT NULL AND tb IS NOT NULL AND abs(a{c} - b{c}) > 1e-8 + 1e-5 * abs(b{c}))"


def thinned(spark, sf):
    """Hourly bars without every seventh event: the second feed."""
    ev = spark.read.parquet(f"{sf}/events.parquet").filter("event_id % 7 <> 0")
    t = F.col("ts").cast("timestamp")
    start = F.timestamp_seconds(F.floor(F.unix_seconds(t) / 3600) * 3600)
    ticks = ev.select(F.col("event_type").alias("ticker"), start.alias("bar_ts"), F.unix_micros(t).alias("us"), "event_id", F.col("value").alias("price"), F.lit(1.0).alias("quantity"))
    order = src.wide_order(F.col("us") - F.unix_micros("bar_ts"), F.col("event_id"))
    return src.ticks_to_bars(ticks, ["ticker", "bar_ts"], order).withColumnRenamed("bar_ts", "ts")


@query(
    "feed_comparison",
    with_(FEEDS, select=f"""
SELECT ticker, count(*) FILTER (ta IS NOT NULL AND tb IS NOT NULL) AS both, count(*) FILTER (tb IS NULL) AS only_a, count(*) FILTER (ta IS NULL) AS only_b, {OFF('o')} AS open_differences, {OFF('h')} AS high_differences, {OFF('l')} AS low_differences,
  {OFF('c')} AS close_differences, {r('sum(av) FILTER (tb IS NOT NULL) / sum(bv) FILTER (ta IS NOT NULL)')} AS volume_ratio, {r('avg(av / bv) FILTER (ta IS NOT NULL AND tb IS NOT NULL)')} AS mean_bar_volume_ratio,
  {r('count(*) FILTER (ta IS NOT NULL AND tb IS NOT NULL) * 100e0 / count(*)')} AS overlap_pct, CASE WHEN count(*) FILTER (ta IS NULL OR tb IS NULL) > 0 THEN 'different_timestamps' ELSE 'same_timestamps_different_values' END AS parity FROM fj GROUP BY ticker"""),
)
def _(spark, sf):
    return tidy(ds.compare_feeds(src.event_bars(spark, sf, 60), thinned(spark, sf)))


@query(
    "feed_repeatability",
    with_(event_bars(60), select="SELECT ticker, count(*) AS rows_1, count(*) AS rows_2, true AS repeatable FROM bars GROUP BY ticker"),
)
def _(spark, sf):
    cols = ["ticker", "ts", "open", "high", "low", "close", "volume"]
    out = ds.repeatability(src.event_bars(spark, sf, 60), src.event_bars(spark, sf, 60), ["ticker"], cols)
    return out.select("ticker", "rows_1", "rows_2", "repeatable")


@query(
    "timestamp_semantics",
    with_(event_bars(60), SESSIONS, """
v AS (SELECT ticker, s.d, count(*) FILTER (epoch(ts - opens)::BIGINT % 3600 = 0) AS g, count(*) AS n, bool_or(ts = opens) AS o, bool_or(ts = closes) AS c FROM bars JOIN sess s ON ts BETWEEN opens AND closes AND NOT early GROUP BY 1, 2)""",
        select="SELECT ticker, CASE WHEN g < 5 THEN 'undetermined' WHEN o AND NOT c THEN 'bar_start' WHEN c AND NOT o THEN 'bar_end' ELSE 'ambiguous' END AS vote, count(*) AS sessions FROM v GROUP BY 1, 2"),
)
def _(spark, sf):
    bars = src.event_bars(spark, sf, 60)
    v = ds.timestamp_votes(bars, event_calendar(bars), 60)
    return v.groupBy("ticker", "vote").agg(F.count(F.lit(1)).alias("sessions"))


@query(
    "date_bound_class",
    with_(DAILY, select="""
SELECT ticker, i AS in_range, o AS out_of_range, CASE WHEN i / 366e0 * 100 >= 60 THEN 'superset_with_complete_requested_range' ELSE 'clipped_but_contains_partial_requested_range' END AS date_bound
FROM (SELECT ticker, count(*) FILTER (ts::DATE BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') AS i, count(*) FILTER (ts::DATE NOT BETWEEN DATE '2000-01-01' AND DATE '2000-12-31') AS o FROM bars GROUP BY 1)"""),
)
def _(spark, sf):
    return ds.date_bound(src.daily_bars(spark, sf), "2000-01-01", "2000-12-31", 366, 60.0).drop("first", "last")


@query(
    "bundle_cross_check",
    with_(DAILY, """
k AS (SELECT DISTINCT ticker, strftime(ts, '%Y-%m') AS m FROM bars), u AS (SELECT * FROM k WHERE m NOT LIKE '%-07'), z AS (SELECT * FROM k UNION ALL SELECT * FROM k WHERE m LIKE '%-01')""",
        select="SELECT ticker, m AS effective_month, 1::BIGINT AS n_manifest, (m NOT LIKE '%-07')::BIGINT AS n_universe, CASE WHEN m LIKE '%-01' THEN 2 ELSE 1 END::BIGINT AS n_quality FROM k WHERE m LIKE '%-07' OR m LIKE '%-01'"),
)
def _(spark, sf):
    k = src.daily_bars(spark, sf).select("ticker", F.date_format("ts", "yyyy-MM").alias("effective_month")).distinct()
    parts = {"manifest": k, "universe": k.filter("effective_month NOT LIKE '%-07'"), "quality": k.unionByName(k.filter("effective_month LIKE '%-01'"))}
    return tidy(ds.bundle_check(parts))


@query(
    "facts_as_of",
    with_("""
fc AS MATERIALIZED (SELECT c_nationkey AS key, o_orderdate::DATE AS pe, (o_orderdate + to_days((o_orderkey % 90)::INT))::DATE AS filed, o_orderdate + to_days((o_orderkey % 90)::INT) + to_hours((o_custkey % 72)) AS acc, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey),
rq AS (SELECT DISTINCT key, date_trunc('month', pe)::TIMESTAMP AS as_of FROM fc)""",
        select=f"""
SELECT q.key::BIGINT AS key, {day('q.as_of')} AS as_of, {day('pe')} AS period_end, {day('filed')} AS filed, {r('v', 2)} AS value FROM rq q LEFT JOIN (
  SELECT q.key, q.as_of, f.pe, f.filed, f.v FROM rq q JOIN fc f ON f.key = q.key AND f.pe <= q.as_of AND f.filed <= q.as_of AND f.acc <= q.as_of
  QUALIFY row_number() OVER (PARTITION BY q.key, q.as_of ORDER BY f.pe DESC, f.filed DESC, f.v DESC) = 1) b ON b.key = q.key AND b.as_of = q.as_of"""),
)
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 90) * 86_400
    facts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("key"), F.to_date("o_orderdate").alias("period_end"), F.to_date(F.timestamp_seconds(at)).alias("filed"),
        F.timestamp_seconds(at + (F.col("o_custkey") % 72) * 3_600).alias("accepted_at"), F.col("o_totalprice").alias("value"),
    )
    asked = facts.select("key", F.date_trunc("month", "period_end").alias("as_of")).distinct()
    return tidy(ds.newest_fact_as_of(asked, facts), 2)


@query(
    "first_tickers_per_sector",
    with_(select="SELECT c_mktsegment AS sector, c_name AS ticker, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS position FROM customer WHERE c_acctbal > 0 QUALIFY position <= 25").replace("WITH RECURSIVE \n", ""),
)
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").filter("c_acctbal > 0").select(F.col("c_mktsegment").alias("sector"), F.col("c_name").alias("ticker"))
    return tidy(ds.first_per_sector(c, 25))


@query("top_market_cap", with_(select=f"SELECT c_name AS ticker, {r('coalesce(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END, 0)', 2)} AS market_cap FROM customer ORDER BY 2 DESC, 1 LIMIT 100").replace("WITH RECURSIVE \n", ""))
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_name").alias("ticker"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("market_cap"))
    return tidy(ds.top_by_cap(c, 100), 2)


@query(
    "symbol_normalisation",
    with_(select="SELECT s AS ticker, min(p_partkey) AS pos FROM (SELECT upper(replace(p_type, ' ', '')) || p_size AS s, p_partkey FROM part) GROUP BY 1").replace("WITH RECURSIVE \n", ""),
)
def _(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    raw = p.select(F.concat(F.lit(" $"), F.lower(F.regexp_replace("p_type", " ", "")), F.col("p_size"), F.lit(" ")).alias("symbol"), F.col("p_partkey").alias("pos"))
    return ds.distinct_symbols(raw)


@query(
    "family_dispositions",
    with_(select="""
WITH ev AS (SELECT c_mktsegment AS f, avg(c_acctbal) > 4500 AS balance, count(*) > 250 AS size, min(c_acctbal) < 0 AS debts, bool_or(c_custkey % 2 = 0 AND c_mktsegment <> 'MACHINERY') AS tried FROM customer GROUP BY 1),
bl AS (SELECT *, list_sort(list_filter([CASE WHEN NOT balance THEN 'minimum_usable_contract.balance not satisfied' END, CASE WHEN NOT size THEN 'minimum_usable_contract.size not satisfied' END, CASE WHEN f = 'BUILDING' THEN 'minimum_usable_contract.history not satisfied' END], lambda x: x IS NOT NULL)) AS b FROM ev)
SELECT f AS family, CASE WHEN len(b) > 0 THEN 'not_supported' ELSE 'supported_with_documented_limitations' END AS disposition, 'limited_but_usable_evidence' AS evidence_confidence, array_to_string(b, '|') AS blockers,
  CASE WHEN len(b) > 0 AND NOT tried THEN 'No provider attempt recorded for this family.' ELSE '' END AS limitations, CASE WHEN (SELECT count(*) FROM bl WHERE len(b) > 0) > 0 THEN 'not_supported' ELSE 'supported_with_documented_limitations' END AS overall_disposition, 'limited_but_usable_evidence' AS overall_confidence FROM bl""").replace("WITH RECURSIVE \n", "").lstrip(),
)
def _(spark, sf):
    """Evidence of data families against their minimum contracts."""
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumnRenamed("c_mktsegment", "family")
    flags = F.array(*[F.struct(F.lit(n).alias("flag"), x.alias("satisfied")) for n, x in (("balance", F.col("a") > 4500), ("size", F.col("n") > 250), ("debts", F.col("m") < 0))])
    per = c.groupBy("family").agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("m"), F.bool_or((F.col("c_custkey") % 2 == 0) & (F.col("family") != "MACHINERY")).alias("attempted"))
    evidence = per.select("family", "attempted", F.inline(flags))
    families = per.select("family")
    contract = families.select("family", F.explode(F.array(F.lit("balance"), F.lit("size"))).alias("flag")).withColumn("required", F.lit(True)).unionByName(
        families.filter("family = 'BUILDING'").select("family", F.lit("history").alias("flag"), F.lit(True).alias("required"))).unionByName(families.select("family", F.lit("debts").alias("flag"), F.lit(False).alias("required")))
    return tidy(ds.family_dispositions(evidence, contract))
