"""Dataset building and checking: securities, universe, symbol-month quality, feeds, manifests, facts."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import clean_symbol
from ..operators.calendar import daily_span_of, day_facts, local_day
from .context import as_of_join

# ---- securities ---------------------------------------------------------------------------------

# Classes of provider type codes, key words of names, SIC codes and class labels.
OTHER_CLASS = "other_structurally_incomparable_securities"
TYPE_CLASSES = {
    "PFD": "preferred_stock", "WARRANT": "warrant", "RIGHT": "right", "UNIT": "unit", "ETN": "ETN", "BOND": OTHER_CLASS, "SP": OTHER_CLASS,
    "ADRC": OTHER_CLASS, "ADRP": "preferred_stock", "ADRW": "warrant", "ADRR": "right", "ETV": OTHER_CLASS, "BASKET": OTHER_CLASS,
}
SPAC_WORDS = ["spac", "blank check", "blank-check", "acquisition corp", "acquisition company", "hedosophia", "social capital", "special purpose", "newmont acquisition"]
ETF_WORDS = ["etf", "exchange traded fund"]
ETN_WORDS = ["etn", "exchange traded note"]
PREFERRED_WORDS = ["preferred stock", "preference share", "preferred share", "preferred a", "preferred b", "preferred c", "preferred d"]
WARRANT_WORDS, RIGHT_WORDS, UNIT_WORDS = ["warrant"], [" right", "rights"], ["unit"]
CLOSED_END_WORDS = ["closed-end", "closed end", "closedend", "fnd"]
COMMON_WORDS = ["inc", "corp", "corporation", "company", "plc", "ltd", "limited", "holdings", "group", "enterprises"]
SPAC_SIC, SHELL_SIC = "6770", "6799"
# End of the fixed values.


def _holds(text: Column, words: Sequence[str]) -> Column:
    out = text.contains(words[0])
    for word in words[1:]:
        out = out | text.contains(word)
    return out


def name_class(name: Column) -> Column:
    """Class that a security's name tells, or null; funds go before what they hold."""
    n = F.lower(F.coalesce(name, F.lit("")))
    fund = n.contains("fund") & ~(n.contains("reit") | n.contains("investment trust") | n.contains("mutual"))
    return (
        F.when(_holds(n, ETF_WORDS), "ETF").when(_holds(n, ETN_WORDS), "ETN").when(_holds(n, PREFERRED_WORDS), "preferred_stock")
        .when(_holds(n, WARRANT_WORDS), "warrant").when(_holds(n, RIGHT_WORDS), "right").when(_holds(n, UNIT_WORDS), "unit")
        .when(_holds(n, CLOSED_END_WORDS) | fund, "closed_end_fund").when(_holds(n, SPAC_WORDS), "pre_merger_spac")
        .when(n.contains("shell company") | (F.trim(n) == "shell"), "shell_company")
    )


def security_class(name: Column, code: Column, market: Column, exchange: Column, sic: Column, sic_description: Column, common_description: Column) -> Column:
    """Class of a listed security as of its date.

    Market and exchange decide first, then specific type codes, then blank-check and shell signs, then the fund codes, then the
    name. The generic code ``CS`` is common stock only if the provider describes it so (``common_description``), and the name has a
    company's word. All else is unknown.
    """
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    n, m, kind, number = text(name), text(market), F.upper(F.coalesce(code, F.lit(""))), F.coalesce(sic, F.lit(""))
    spac = (number == SPAC_SIC) | text(sic_description).contains("blank") | _holds(n, SPAC_WORDS)
    shell = n.contains("shell company") | (F.trim(n) == "shell") | (number == SHELL_SIC)
    out = F.when((m == "otc") | (F.coalesce(exchange, F.lit("")) == ""), "OTC")
    for known, label in TYPE_CLASSES.items():
        out = out.when(kind == known, label)
    return (
        out.when(spac, "pre_merger_spac").when(shell, "shell_company").when(kind == "ETF", "ETF")
        .when(kind == "FUND", F.when(m == "stocks", "closed_end_fund").otherwise(OTHER_CLASS))
        .when(name_class(name).isNotNull(), name_class(name))
        .when((kind == "CS") & text(common_description).contains("common stock") & _holds(n, COMMON_WORDS), "common_stock")
        .otherwise("unknown")
    )


def eligibility_verdicts(securities: DataFrame, types: Sequence[str], excluded: Sequence[str], exchanges: Sequence[str]) -> DataFrame:
    """First reason a listed security is left out; an empty reason means eligible."""
    s = securities.withColumn("ticker", F.upper(F.trim(F.coalesce("ticker", F.lit("")))))
    copies = s.filter("ticker <> ''").groupBy("ticker").agg(F.count(F.lit(1)).alias("_n"))
    kind, exchange = F.lower("category"), F.upper(F.trim(F.coalesce("primary_exchange", F.lit(""))))
    reason = (
        F.when(F.col("ticker") == "", "blank_ticker").when(F.col("_n") > 1, "duplicate_symbol")
        .when(kind.isin(*excluded) | ~kind.isin(*types), F.concat(F.lit("security_type:"), F.col("category")))
        .when(exchange == "", "missing_exchange")
        .when(~exchange.isin(*exchanges), F.concat(F.lit("exchange_not_allowed:"), exchange)).otherwise("")
    )
    return s.join(copies, "ticker", "left").withColumn("reason", reason).drop("_n")


def distinct_symbols(symbols: DataFrame) -> DataFrame:
    """Order-keeping distinct of cleaned symbols (first position wins)."""
    return symbols.withColumn("ticker", clean_symbol(F.col("symbol"))).filter("ticker IS NOT NULL").groupBy("ticker").agg(F.min("pos").alias("pos"))


def inactive_only(inactive: DataFrame, active: DataFrame) -> DataFrame:
    return inactive.join(active.select("ticker"), "ticker", "left_anti")


# ---- universe -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class UniverseRule:
    prior_sessions: int = 20
    min_close: float = 5.0
    min_dollar_volume: float = 50_000_000.0
    top_n: int = 50


def monthly_liquidity(daily: DataFrame, months: DataFrame, sessions: DataFrame, rule: UniverseRule) -> DataFrame:
    """Prior close and median dollar volume over the last sessions before each month, per ticker.

    ``months``: effective_month, pit_date. The wanted sessions are a small table (months x sessions),
    so the bars meet them by session date and combine map-side.
    """
    numbered = sessions.select("session_date", "session_no")
    asked = months.select(F.col("pit_date").alias("session_date"))  # may lie past the last session
    days = day_facts(daily_span_of(sessions).unionByName(asked).distinct(), sessions).select(F.col("session_date").alias("pit_date"), F.col("session_on_or_before").alias("session_date"))
    last = months.join(days, "pit_date").join(numbered, "session_date").select("effective_month", "pit_date", F.col("session_no").alias("_last"))
    wanted = last.withColumn("session_no", F.explode(F.sequence(F.col("_last") - rule.prior_sessions + 1, F.col("_last")))).join(numbered, "session_no")
    rows = daily.withColumn("session_date", F.to_date("ts")).join(F.broadcast(wanted.select("effective_month", "pit_date", "session_date")), "session_date")
    return rows.groupBy("effective_month", "pit_date", "ticker").agg(
        F.max_by("close", "ts").alias("prior_close"), F.median(F.col("close") * F.col("volume")).alias("median_dollar_volume"),
        F.count(F.lit(1)).alias("valid_sessions"),
    )


def monthly_universe(liquidity: DataFrame, rule: UniverseRule) -> DataFrame:
    """Top names per month by median dollar volume (ties by ticker), with rank and exclusion reason."""
    enough = F.col("valid_sessions") >= rule.prior_sessions
    ok = enough & (F.col("prior_close") >= rule.min_close) & (F.col("median_dollar_volume") >= rule.min_dollar_volume)
    marked = liquidity.withColumn("qualified", ok)
    # one row per listed ticker and month: bounded by the number of listings
    order = Window.partitionBy("effective_month", "qualified").orderBy(F.desc("median_dollar_volume"), "ticker")
    ranked = marked.withColumn("_rank", F.row_number().over(order))
    included = F.col("qualified") & (F.col("_rank") <= rule.top_n)
    reason = (
        F.when(included, "").when(~enough, "insufficient_liquidity_data")
        .when(F.col("prior_close") < rule.min_close, "below_prior_close_threshold")
        .when(F.col("median_dollar_volume") < rule.min_dollar_volume, "below_median_volume_threshold").otherwise("not_in_top")
    )
    return ranked.withColumns({"included": included, "liquidity_rank": F.when(included, F.col("_rank")), "exclusion_reason": reason}).drop("_rank", "qualified")


def first_per_sector(rows: DataFrame, n: int) -> DataFrame:
    """First n tickers per sector in alphabetical order."""
    order = Window.partitionBy("sector").orderBy("ticker")  # one row per listed ticker
    return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= n).withColumnRenamed("_k", "position")


def top_by_cap(rows: DataFrame, n: int = 100) -> DataFrame:
    return rows.withColumn("market_cap", F.coalesce("market_cap", F.lit(0.0))).orderBy(F.desc("market_cap"), "ticker").limit(n)


# ---- symbol-month quality -----------------------------------------------------------------------

def month_quality(bars: DataFrame, sessions: DataFrame, invalid: Column) -> DataFrame:
    """Expected and actual sessions, missing, zero-volume and invalid rates per (month, symbol)."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    expected = sessions.groupBy(month("session_date").alias("effective_month")).agg(F.count(F.lit(1)).alias("expected_sessions"))
    on = bars.withColumn("session_date", F.to_date("ts")).join(F.broadcast(sessions.select("session_date")), "session_date")
    got = on.groupBy(month("session_date").alias("effective_month"), "ticker").agg(
        F.count(F.lit(1)).alias("actual_sessions"), F.count_if(invalid).alias("invalid_rows"), F.count_if(F.col("volume") == 0).alias("zero_volume_bars"),
    )
    j = got.join(F.broadcast(expected), "effective_month")
    pct = lambda c: F.col(c) / F.col("expected_sessions") * 100
    return j.withColumn("missing_rate_pct", (F.col("expected_sessions") - F.col("actual_sessions")) / F.col("expected_sessions") * 100).withColumn("zero_volume_rate_pct", pct("zero_volume_bars"))


def month_rejections(quality: DataFrame, max_missing: float = 5.0, max_zero: float = 10.0) -> DataFrame:
    """Rejection mask and reasons of every symbol-month."""
    reasons = F.array_join(F.array_compact(F.array(
        F.when(F.col("invalid_rows") > 0, "invalid_ohlc"), F.when(F.col("missing_rate_pct") > max_missing, "missing_bar_rate"),
        F.when(F.col("zero_volume_rate_pct") > max_zero, "zero_volume_rate"),
    )), "; ")
    return quality.withColumn("rejection_reason", reasons).withColumns(
        {"invalid": F.col("invalid_rows") > 0, "quality_rejected": (F.col("invalid_rows") == 0) & (F.col("rejection_reason") != "")}
    )


def monthly_summary(rejections: DataFrame, max_rejected_pct: float = 5.0) -> DataFrame:
    """Per month and in total: symbols, rejected counts and share, breach of the limit."""
    s = rejections.rollup("effective_month").agg(
        F.grouping("effective_month").alias("_all"), F.count(F.lit(1)).alias("total_symbols"), F.count_if("invalid").alias("invalid_symbols"), F.count_if("quality_rejected").alias("quality_rejected"),
    )
    pct = (F.col("invalid_symbols") + F.col("quality_rejected")) / F.col("total_symbols") * 100
    return s.withColumn("effective_month", F.when(F.col("_all") == 1, "total").otherwise(F.col("effective_month"))).withColumn("rejected_pct", pct).withColumn(
        "breaches", F.col("rejected_pct") > max_rejected_pct
    ).drop("_all")


def disposition(summary: DataFrame) -> DataFrame:
    months = F.col("effective_month") != "total"
    return summary.agg(
        F.when(F.bool_or(months & (F.col("invalid_symbols") > 0)), "invalid").when(F.bool_or(months & F.col("breaches")), "inconclusive").otherwise("valid").alias("disposition"),
        F.count_if(months & F.col("breaches")).alias("breached_months"),
    )


def observed_rejection(reason: Column, ignored: str = "pre_normalization_metrics_unavailable") -> Column:
    """True when a rejection has a reason besides the ignored one."""
    return F.size(F.filter(F.split(F.coalesce(reason, F.lit("")), r"; *"), lambda x: (x != ignored) & (x != ""))) > 0


def daily_quality(bars: DataFrame, sessions: DataFrame, invalid: Column, trailing: int = 252) -> DataFrame:
    """Malformed and zero-volume counts and completeness over all and over the trailing sessions."""
    days = bars.groupBy("ticker", F.to_date("ts").alias("session_date")).agg(F.count(F.lit(1)).alias("n"), F.count_if(invalid).alias("bad"), F.count_if(F.col("volume") == 0).alias("zero"))
    numbered = F.broadcast(sessions.select("session_date", "session_no"))
    back = sessions.select(F.col("session_date").alias("session_on_or_before"), F.col("session_no").alias("last_no"))
    per = days.join(numbered, "session_date", "left").groupBy("ticker").agg(
        F.sum("n").alias("total_bars"), F.sum("bad").alias("malformed_count"), F.sum(F.col("n") - 1).alias("duplicate_count"), F.sum("zero").alias("zero_volume_count"),
        F.count("session_no").alias("actual_sessions"), F.min("session_no").alias("first_no"), F.max("session_no").alias("last_no"),
    )
    recent = days.join(numbered, "session_date").join(per.select("ticker", "last_no"), "ticker").filter(F.col("session_no") > F.col("last_no") - trailing)
    seen = recent.groupBy("ticker").agg((F.count(F.lit(1)) / trailing).alias("trailing_completeness"))
    expected = F.col("last_no") - F.col("first_no") + 1
    return per.join(seen, "ticker", "left").withColumn("all_completeness", F.col("actual_sessions") / expected).drop("first_no", "last_no")


# ---- feeds --------------------------------------------------------------------------------------

def compare_feeds(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("ticker", "ts")) -> DataFrame:
    """Per ticker: overlap of two feeds, volume ratios and price differences beyond tolerance."""
    cols = ["open", "high", "low", "close", "volume"]
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("in_b"))
    j = left.join(right, list(keys), "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    off = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) > 1e-8 + 1e-5 * F.abs(F.col(f"b_{c}"))
    ratio = F.when(both & (F.col("b_volume") > 0), F.col("a_volume") / F.col("b_volume"))
    out = j.groupBy("ticker").agg(
        F.count_if(both).alias("both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"),
        *[F.count_if(both & off(c)).alias(f"{c}_differences") for c in cols[:4]],
        (F.sum(F.when(both, F.col("a_volume"))) / F.sum(F.when(both, F.col("b_volume")))).alias("volume_ratio"), F.avg(ratio).alias("mean_bar_volume_ratio"),
    )
    same = (F.col("only_a") + F.col("only_b")) == 0
    differ = sum((F.col(f"{c}_differences") for c in cols[:4]), F.lit(0)) > 0
    return out.withColumn("overlap_pct", F.col("both") / (F.col("both") + F.col("only_a") + F.col("only_b")) * 100).withColumn(
        "parity", F.when(same & ~differ, "identical").when(same, "same_timestamps_different_values").otherwise("different_timestamps")
    )


def content_hash(rows: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free content fingerprint per group: row count and sum of row hashes, combined map-side."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("fingerprint"))


def repeatability(first: DataFrame, second: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    a = content_hash(first, groups, columns).withColumnsRenamed({"rows": "rows_1", "fingerprint": "fingerprint_1"})
    b = content_hash(second, groups, columns).withColumnsRenamed({"rows": "rows_2", "fingerprint": "fingerprint_2"})
    same = (F.col("rows_1") == F.col("rows_2")) & (F.col("fingerprint_1") == F.col("fingerprint_2"))
    return a.join(b, list(groups), "full").withColumn("repeatable", F.coalesce(same, F.lit(False)))


def timestamp_votes(bars: DataFrame, sessions: DataFrame, bar_minutes: int) -> DataFrame:
    """Bar-start or bar-end vote per (ticker, session): at least 90 % of the grid must be present."""
    s = F.broadcast(sessions.filter(~F.col("is_early_close")).select("opens_at", "closes_at", F.col("session_date")))
    j = bars.withColumn("session_date", local_day("ts")).join(s, "session_date").filter((F.col("ts") >= F.col("opens_at")) & (F.col("ts") <= F.col("closes_at")))
    step = bar_minutes * 60
    expected = (F.unix_seconds("closes_at") - F.unix_seconds("opens_at")) / step
    v = j.groupBy("ticker", "session_date").agg(
        F.count_if((F.unix_seconds("ts") - F.unix_seconds("opens_at")) % step == 0).alias("on_grid"), F.count(F.lit(1)).alias("n"), F.max(expected).alias("expected"),
        F.bool_or(F.col("ts") == F.col("opens_at")).alias("has_open"), F.bool_or(F.col("ts") == F.col("closes_at")).alias("has_close"),
    )
    vote = (
        F.when(F.col("on_grid") < F.greatest(F.lit(1), F.floor(F.col("expected") * 0.9)), "undetermined")
        .when(F.col("has_open") & ~F.col("has_close"), "bar_start").when(F.col("has_close") & ~F.col("has_open"), "bar_end")
        .when(F.col("has_open") & F.col("has_close") & (F.col("n") == F.col("expected") + 1), "bar_start").otherwise("ambiguous")
    )
    return v.withColumn("vote", vote)


def timestamp_verdict(votes: DataFrame) -> DataFrame:
    has = lambda v: F.bool_or(F.col("vote") == v)
    every = lambda v: F.bool_and(F.col("vote") == v)
    return votes.groupBy("ticker").agg(
        F.when(every("bar_start"), "bar_start").when(every("bar_end"), "bar_end").when(has("ambiguous") | (has("bar_start") & has("bar_end")), "ambiguous")
        .otherwise("undetermined").alias("semantics")
    )


def date_bound(bars: DataFrame, start: str, end: str, expected: int, threshold_pct: float) -> DataFrame:
    """How a requested date range was honoured, per ticker."""
    d = F.to_date("ts")
    a, z = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = d.between(a, z)
    f = bars.groupBy("ticker").agg(F.count_if(inside).alias("in_range"), F.count_if(~inside).alias("out_of_range"), F.min(d).alias("first"), F.max(d).alias("last"))
    meets = F.col("in_range") / expected * 100 >= threshold_pct
    cls = (
        F.when((F.col("in_range") == 0) & (F.col("out_of_range") > 0), "clipped_to_recent_history").when(F.col("in_range") == 0, "empty")
        .when((F.col("out_of_range") > 0) & meets, "superset_with_complete_requested_range").when(F.col("out_of_range") > 0, "clipped_but_contains_partial_requested_range")
        .when(meets, "honored_exactly")
        .when((F.col("last") >= F.date_sub(z, 180)) & (F.col("first") > F.date_add(a, 30)), "clipped_to_recent_history").otherwise("clipped_but_contains_partial_requested_range")
    )
    return f.withColumn("date_bound", cls)


# ---- manifests and facts ------------------------------------------------------------------------

def bundle_check(parts: dict[str, DataFrame], keys: Sequence[str] = ("ticker", "effective_month")) -> DataFrame:
    """Key sets of several tables compared: one row per key that is absent or repeated somewhere."""
    out = None
    for name, frame in parts.items():
        counted = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = counted if out is None else out.join(counted, list(keys), "full")
    counts = [F.coalesce(F.col(f"n_{n}"), F.lit(0)) for n in parts]
    out = out.select(*keys, *[c.alias(f"n_{n}") for c, n in zip(counts, parts)])
    return out.filter((F.least(*[F.col(f"n_{n}") for n in parts]) != 1) | (F.greatest(*[F.col(f"n_{n}") for n in parts]) != 1))


def newest_fact_as_of(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Fact with the latest period end (then filing date) known at each request: period, filing and acceptance all past.

    A fact becomes known at the latest of its three dates, so the bitemporal rule is an as-of join on
    that moment keeping the highest (period end, filing date).
    """
    known = facts.withColumn("ts", F.greatest(F.col("period_end").cast("timestamp"), F.col("filed").cast("timestamp"), F.col("accepted_at")))
    asked = requests.withColumn("ts", F.col("as_of"))
    return as_of_join(asked, known, ["key"], ["period_end", "filed", "value"], best=["period_end", "filed", "value"]).drop("ts", "asof_ts")


def family_dispositions(evidence: DataFrame, contract: DataFrame) -> DataFrame:
    """One row per data family of the contract: disposition, confidence, blockers, limitations, and the overall disposition and confidence.

    ``contract`` has family, flag and required; ``evidence`` family, flag, satisfied, attempted (a provider was asked). A required flag that no
    evidence satisfies blocks its family. A family without an attempt is told apart by a limitation. One blocked family blocks the whole.
    """
    # Dispositions, confidence and texts.
    met = evidence.groupBy("family", "flag").agg(F.bool_or("satisfied").alias("satisfied"))
    tried = evidence.groupBy("family").agg(F.bool_or("attempted").alias("attempted"))
    needed = contract.join(met, ["family", "flag"], "left").withColumn("_unmet", F.col("required") & ~F.coalesce("satisfied", F.lit(False)))
    blocked = F.when(F.col("_unmet"), F.concat(F.lit("minimum_usable_contract."), "flag", F.lit(" not satisfied")))
    per = needed.groupBy("family").agg(F.array_sort(F.collect_list(blocked)).alias("blockers")).join(tried, "family", "left")  # a family's flags are few
    bad = F.size("blockers") > 0
    out = per.select(
        "family", F.when(bad, "not_supported").otherwise("supported_with_documented_limitations").alias("disposition"), F.lit("limited_but_usable_evidence").alias("evidence_confidence"), "blockers",
        F.when(bad & ~F.coalesce("attempted", F.lit(False)), F.array(F.lit("No provider attempt recorded for this family."))).otherwise(F.array().cast("array<string>")).alias("limitations"))
    whole = out.agg(F.when(F.bool_or(F.col("disposition") == "not_supported"), "not_supported").otherwise("supported_with_documented_limitations").alias("overall_disposition"))
    return out.crossJoin(F.broadcast(whole)).withColumn("overall_confidence", F.lit("limited_but_usable_evidence"))
