"""Building blocks of the DuckDB oracle: other formulations of the same results."""
from __future__ import annotations

DAILY = """
px AS (
  SELECT p_brand AS ticker, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS quantity,
         (l_orderkey, l_linenumber, l_partkey * 31 + l_suppkey) AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS MATERIALIZED (
  SELECT ticker, ts, first(price ORDER BY ord) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ord) AS close, sum(quantity) AS volume
  FROM px GROUP BY ticker, ts)"""

MARKET = """
mk AS MATERIALIZED (
  SELECT ts, first(price ORDER BY ord) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ord) AS close, sum(quantity) AS volume
  FROM px GROUP BY ts)"""


def event_bars(minutes: int, name: str = "bars", user_groups: int = 1) -> str:
    s = minutes * 60
    ticker = "event_type" if user_groups == 1 else f"event_type || '-' || (user_id % {user_groups})"
    return f"""
{name} AS MATERIALIZED (
  SELECT {ticker} AS ticker, to_timestamp(floor(epoch(ts) / {s})::BIGINT * {s})::TIMESTAMP AS ts,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""


def numbered(src: str = "bars", name: str = "b", keys: str = "ticker") -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS pos,
         lag(close) OVER (PARTITION BY {keys} ORDER BY ts) AS pc
  FROM {src})"""


def indicators(src: str = "b", name: str = "ind", keys: str = "ticker") -> str:
    """Recursive averages step by step; rolling statistics by windows. Needs ``pos`` and ``pc``."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"n.{k} = p.{k}" for k in ks)
    sel = ", ".join(f"n.{k}" for k in ks)
    join = " AND ".join(f"r.{k} = e.{k}" for k in ks)
    return f"""
{name}_in AS MATERIALIZED (
  SELECT *, avg(tr) OVER (PARTITION BY {keys} ORDER BY pos ROWS 13 PRECEDING) AS tr14 FROM (
    SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
      coalesce(greatest(close - pc, 0), 0) AS up, coalesce(greatest(pc - close, 0), 0) AS dn,
      avg(close) OVER w20 AS mid, stddev_pop(close) OVER w20 AS dev, avg(volume) OVER w20 AS v20
    FROM {src} WINDOW w20 AS (PARTITION BY {keys} ORDER BY pos ROWS 19 PRECEDING))),
{name}_rec AS (
  SELECT {keys}, pos, close AS e12, close AS e26, close AS e20, close AS e50, up AS g, dn AS l, 0e0 AS a, 0e0 AS sg
  FROM {name}_in WHERE pos = 0
  UNION ALL
  SELECT {sel}, n.pos,
    n.close * (2e0/13) + p.e12 * (11e0/13), n.close * (2e0/27) + p.e26 * (25e0/27),
    n.close * (2e0/21) + p.e20 * (19e0/21), n.close * (2e0/51) + p.e50 * (49e0/51),
    (p.g * 13 + n.up) / 14, (p.l * 13 + n.dn) / 14,
    CASE WHEN n.pos < 13 THEN 0e0 WHEN n.pos = 13 THEN n.tr14 ELSE (p.a * 13 + n.tr) / 14 END,
    CASE WHEN n.pos < 25 THEN 0e0
         WHEN n.pos = 25 THEN (n.close * (2e0/13) + p.e12 * (11e0/13)) - (n.close * (2e0/27) + p.e26 * (25e0/27))
         ELSE 0.8e0 * p.sg + 0.2e0 * ((n.close * (2e0/13) + p.e12 * (11e0/13)) - (n.close * (2e0/27) + p.e26 * (25e0/27))) END
  FROM {name}_rec p JOIN {name}_in n ON {on} AND n.pos = p.pos + 1),
{name} AS MATERIALIZED (
  SELECT e.*, CASE WHEN e.pos >= 13 THEN CASE WHEN r.l = 0 THEN 100e0 ELSE 100 - 100 / (1 + r.g / r.l) END END AS rsi,
    CASE WHEN e.pos >= 25 THEN r.e12 - r.e26 END AS macd, CASE WHEN e.pos >= 33 THEN r.sg END AS macd_signal,
    CASE WHEN e.pos >= 33 THEN r.e12 - r.e26 - r.sg END AS macd_diff,
    CASE WHEN e.pos >= 19 THEN r.e20 END AS ema_20, CASE WHEN e.pos >= 49 THEN r.e50 END AS ema_50,
    CASE WHEN e.pos >= 19 THEN mid + 2 * dev END AS bb_upper, CASE WHEN e.pos >= 19 THEN mid - 2 * dev END AS bb_lower,
    CASE WHEN e.pos >= 19 THEN 4 * dev / mid * 100 END AS bb_width, r.a AS atr,
    CASE WHEN e.pos >= 19 THEN v20 END AS volume_sma20, CASE WHEN e.pos >= 19 THEN volume / v20 END AS volume_ratio
  FROM {name}_in e JOIN {name}_rec r ON {join} AND r.pos = e.pos)"""


def short_scores(src: str = "ind", name: str = "sc", keys: str = "ticker") -> str:
    return f"""
{name}_f AS MATERIALIZED (
  SELECT *, coalesce(close > ema_20 AND ema_20 > ema_50, false) AS ema_structure,
    coalesce(volume_ratio >= 1.3e0, false) AS volume_confirmation,
    coalesce(rsi BETWEEN 50 AND 70, false) AS rsi_momentum,
    coalesce(macd > 0 AND macd_diff > 0, false) AS macd_positive,
    coalesce(abs(close - ema_20) / ema_20 < 0.015e0 AND ema_20 > ema_50, false) AS pullback_ema
  FROM {src}),
{name} AS MATERIALIZED (
  SELECT *, (25 * ema_structure::INT + 20 * volume_confirmation::INT + 20 * rsi_momentum::INT
             + 20 * macd_positive::INT + 15 * pullback_ema::INT) AS score
  FROM {name}_f)"""


def with_(*parts: str, select: str, recursive: bool = True) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n" + select


def r(expr: str, digits: int = 4) -> str:
    """Half-up rounding; never a negative zero."""
    return f"(floor(({expr})::DOUBLE * 1e{digits} + 0.5e0) / 1e{digits})"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def minute(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M')"


def bootstrap(clusters: str, by: str, sums: list[str], replicates: int, seed: int, name: str) -> str:
    """Sums of every resample of a group's clusters, drawn one by one: word k of md5 over seed, replicate and k // 4, modulo the clusters."""
    total = ", ".join(f"sum({c}) AS {c}" for c in sums)
    return f"""
{name}_c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY cluster) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS t FROM {clusters}),
{name}_w AS MATERIALIZED (
  SELECT rep, k, ('0x' || substr(md5('{seed}:' || rep || ':' || (k // 4)), (1 + 8 * (k % 4))::INT, 8))::BIGINT AS w
  FROM (SELECT unnest(range({replicates})) AS rep), (SELECT unnest(range((SELECT coalesce(max(t), 0) FROM {name}_c))) AS k)),
{name} AS MATERIALIZED (
  SELECT {by}, rep, {total} FROM (SELECT DISTINCT {by}, t FROM {name}_c) g JOIN {name}_w w ON w.k < g.t JOIN {name}_c c USING ({by}) WHERE c.i = w.w % g.t GROUP BY {by}, rep)"""
