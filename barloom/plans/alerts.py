"""Alert candidates and cooldown decisions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AlertCooldowns
from ..operators.greedy import choose_non_overlapping

KEY = ["ticker", "alert_type", "timeframe"]
# Strengths at which a result becomes an alert.
COIL_MIN, CONFLUENCE_MIN, PATTERN_MIN = 60, 70, 75
GAP_TIERS = ["large", "massive"]


def normalize_key(df: DataFrame, malformed: bool = False) -> DataFrame:
    """Trimmed upper-case ticker, lower-case type and timeframe; with ``malformed`` the rows whose key is none instead of the others."""
    out = df.withColumns({"ticker": F.upper(F.trim("ticker")), "alert_type": F.lower(F.trim("alert_type")), "timeframe": F.lower(F.trim("timeframe"))})
    ok = F.col("ticker").rlike(r"^[A-Z0-9][A-Z0-9.\-#]{0,14}$") & F.col("alert_type").rlike(r"^[a-z][a-z0-9_]*$") & F.col("timeframe").rlike(r"^[a-z0-9]+$")
    ok = F.coalesce(ok, F.lit(False))
    return out.filter(~ok if malformed else ok)


def candidates(coils: DataFrame | None = None, confluence: DataFrame | None = None, matches: DataFrame | None = None, gaps: DataFrame | None = None, timeframe: str = "short") -> DataFrame:
    """One stream of alert candidates (key, strength) out of the screens' results."""
    parts = []
    if coils is not None:
        parts.append(coils.filter(F.col("coil_strength") >= COIL_MIN).select("ticker", F.lit("coil").alias("alert_type"), F.lit(timeframe).alias("timeframe"), F.col("coil_strength").alias("strength")))
    if confluence is not None:
        parts.append(confluence.filter(F.col("confluence_score") >= CONFLUENCE_MIN).select("ticker", F.lit("confluence").alias("alert_type"), F.lit("all").alias("timeframe"), F.col("confluence_score").cast("double").alias("strength")))
    if matches is not None:
        parts.append(matches.filter(F.col("similarity_score") >= PATTERN_MIN).select("ticker", F.concat(F.lit("pattern_"), "event_type").alias("alert_type"), F.lit("daily").alias("timeframe"), F.col("similarity_score").alias("strength")))
    if gaps is not None:
        parts.append(gaps.filter((F.col("status") == "qualified") & F.col("tier").isin(GAP_TIERS)).select("ticker", F.concat(F.lit("gap_"), "tier").alias("alert_type"), F.lit("premarket").alias("timeframe"), F.abs("gap_pct").alias("strength")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cooldown_minutes(config: AlertCooldowns) -> Column:
    """Cooldown of a row's alert type: exact types and the pattern/gap families, else the default."""
    family = F.when(F.col("alert_type").startswith("pattern"), "pattern").when(F.col("alert_type").startswith("gap"), "gap").otherwise(F.col("alert_type"))
    out = F.lit(config.default_minutes)
    for name, minutes in config.by_type.items():
        out = F.when(family == name, minutes).otherwise(out)
    return out


def decide(alerts: DataFrame, config: AlertCooldowns, tie: Sequence[str] = ()) -> DataFrame:
    """sent, failed or suppressed for every alert (key, observed_at, delivered), in time order per key.

    Only a delivered alert starts a cooldown, and it ends on the microsecond. Alerts of one key at the same microsecond are taken
    in the order of the ``tie`` columns; of delivered ones the first is sent, those after it are suppressed, and one that fails before it
    leaves the key free.
    """
    at = F.unix_micros("observed_at")
    held = F.when(F.col("delivered"), cooldown_minutes(config).cast("bigint") * 60_000_000).otherwise(0)
    rows = alerts.withColumn("_s", at).withColumn("_f", at + held)
    instants = rows.groupBy(*KEY, "_s").agg(F.max("_f").alias("_f"))
    longest = max([config.default_minutes, *config.by_type.values()])
    chosen = choose_non_overlapping(instants, KEY, "_s", "_f", max(7 * 86_400, longest * 60) * 1_000_000)
    out = rows.join(chosen.withColumn("_open", F.lit(True)), [*KEY, "_s"], "left")
    order = F.struct(*tie) if tie else F.xxhash64(*alerts.columns)
    instant = Window.partitionBy(*KEY, "_s").orderBy(order)
    started = F.coalesce(F.max("delivered").over(instant.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    positive = cooldown_minutes(config) > 0
    out = out.withColumn("_open", F.col("_open").isNotNull() & ~(started & positive))
    decision = F.when(~F.col("_open"), "suppressed").when(F.col("delivered"), "sent").otherwise("failed")
    until = F.when(decision == "sent", F.timestamp_micros("_f"))
    return out.withColumn("decision", decision).withColumn("cooldown_until", until).drop("_s", "_f", "_open")


def alert_state(decisions: DataFrame) -> DataFrame:
    n = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return decisions.groupBy(*KEY).agg(n("sent"), n("suppressed"), n("failed"), F.max("cooldown_until").alias("cooldown_until"))


def payload_hash(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *columns), 256)
