"""Evidence of the pattern study: signals against frequency-matched controls, bootstrap intervals, gates and their verdict."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even
from ..operators.stats import cluster_bootstrap, exact_quantiles, lift_bootstrap
from ..session import settle

CELL = ["split", "event_type"]
EVENTS = ("runup", "decline")


@dataclass(frozen=True)
class EvidenceSpec:
    """Sample minima, limits and the bootstrap of the study's gates."""

    minimum_validation_signals: int = 100
    minimum_holdout_signals: int = 100
    minimum_tickers: int = 15
    max_ticker_concentration: float = 0.20
    minimum_lift_bps: float = 25.0
    minimum_positive_lift_share: float = 0.55
    resamples: int = 5_000
    seed: int = 20260803


def ticker_sides(obs: DataFrame, controls: DataFrame, value: str) -> DataFrame:
    """Per split, event type and ticker (``cluster``): sum and count of the signals' returns and of the controls'."""
    hit = (F.col("outcome_status") == "complete") & F.col("is_qualifying")
    signals = obs.filter(hit & F.col(value).isNotNull()).groupBy(*CELL, F.col("ticker").alias("cluster")).agg(F.sum(value).alias("sum"), F.count(value).alias("n"))
    other = controls.filter(F.col(value).isNotNull()).groupBy(*CELL, F.col("ticker").alias("cluster")).agg(F.sum(value).alias("other_sum"), F.count(value).alias("other_n"))
    return signals.join(other, [*CELL, "cluster"], "full")


def underfilled(obs: DataFrame) -> DataFrame:
    """Whether some (ticker, year) of a split and event type has fewer non-signals than signals."""
    hit = F.col("is_qualifying")
    per = obs.filter("outcome_status = 'complete'").groupBy(*CELL, "ticker", F.year("decision_date").alias("year")).agg(F.count_if(hit).alias("s"), F.count_if(~hit).alias("p"))
    return per.groupBy(*CELL).agg(F.bool_or(F.col("p") < F.col("s")).alias("controls_underfilled"))


def evidence(obs: DataFrame, controls: DataFrame, value: str, spec: EvidenceSpec = EvidenceSpec()) -> DataFrame:
    """One row per split and event type: what the gates look at.

    ``obs`` and ``controls`` are written tables. The mean's interval resamples tickers with signals, the lift's those with signals and
    controls. Where controls are underfilled, lift and baseline are null. Ticker lifts need both sides.
    """
    hits = obs.filter((F.col("outcome_status") == "complete") & F.col("is_qualifying") & F.col(value).isNotNull())
    sides = settle(ticker_sides(obs, controls, value))
    own = sides.filter(F.col("n") > 0)
    mean = cluster_bootstrap(own, CELL, "sum", "n", spec.resamples, spec.seed)
    lift = lift_bootstrap(sides, CELL, spec.resamples, spec.seed)
    tickers = own.groupBy(*CELL).agg(
        F.sum("n").alias("qualifying_signals"), F.count(F.lit(1)).alias("ticker_count"), half_even(F.max("n") / F.sum("n"), 6).alias("max_ticker_concentration"))
    each = sides.withColumn("_lift", half_even((F.try_divide("sum", "n") - F.try_divide("other_sum", "other_n")) * 100, 6)).filter(F.col("_lift").isNotNull())
    breadth = each.groupBy(*CELL).agg(half_even(F.avg((F.col("_lift") > 0).cast("double")), 6).alias("pct_tickers_positive_lift"))
    middle_lift = exact_quantiles(each, CELL, "_lift", {"median_ticker_lift_bps": 0.5})
    dates = hits.groupBy(*CELL).agg(F.array_sort(F.collect_set("decision_date")).alias("d"))  # bounded by the calendar
    middle = F.broadcast(dates.select(*CELL, F.get("d", F.floor(F.size("d") / 2).cast("int")).alias("_mid")))
    first = F.col("decision_date") <= F.col("_mid")
    halves = hits.join(middle, CELL).groupBy(*CELL).agg(
        half_even(F.avg(F.when(first, F.col(value))), 6).alias("first_half_mean_return_pct"), half_even(F.avg(F.when(~first, F.col(value))), 6).alias("second_half_mean_return_pct"))
    out = (
        underfilled(obs).join(tickers, CELL, "left")
        .join(mean.select(*CELL, half_even(F.col("estimate"), 6).alias("mean_net_return_pct"), half_even(F.col("ci_low"), 6).alias("mean_ci_low"), half_even(F.col("ci_high"), 6).alias("mean_ci_high")), CELL, "left")
        .join(lift.select(*CELL, "common_clusters", *[half_even(F.col(a), 6).alias(b) for a, b in (("lift", "lift_bps"), ("ci_low", "lift_ci_low"), ("ci_high", "lift_ci_high"))]), CELL, "left")
    )
    for part in (breadth, middle_lift, halves):
        out = out.join(part, CELL, "left")
    fine = F.when(~F.col("controls_underfilled"), F.lit(True))
    return out.withColumns({c: F.when(fine, F.col(c)) for c in ("lift_bps", "lift_ci_low", "lift_ci_high")}).withColumn(
        "qualifying_signals", F.coalesce("qualifying_signals", F.lit(0))).withColumn("ticker_count", F.coalesce("ticker_count", F.lit(0)))


def _gates(spec: EvidenceSpec) -> list[tuple[str, bool, Column, Column, str]]:
    """Gate name, whether it is a sample gate, value, test (over a row of one event type with both splits) and the text of a failure."""
    out = []

    def add(name, sample, value, test, text):
        out.append((name, sample, value, F.coalesce(test, F.lit(False)), text))

    of = lambda split, c: F.col(f"{split}.{c}")
    both = ("validation", "holdout")
    count = lambda s, c: F.coalesce(of(s, c), F.lit(0))
    # Gate names and failure texts.
    for s, least in zip(both, (spec.minimum_validation_signals, spec.minimum_holdout_signals)):
        add(f"{s}_signals", True, count(s, "qualifying_signals"), of(s, "qualifying_signals") >= least, f"fewer than {least} {s} signals")
    for s in both:
        add(f"{s}_tickers", True, count(s, "ticker_count"), of(s, "ticker_count") >= spec.minimum_tickers, f"fewer than {spec.minimum_tickers} {s} tickers")
    for s in both:
        share = of(s, "max_ticker_concentration")
        add(f"{s}_max_ticker_concentration", True, share, of(s, "split").isNotNull() & (share.isNull() | (share <= spec.max_ticker_concentration)), f"ticker concentration above {spec.max_ticker_concentration:g}")
    for s in both:
        few = of(s, "controls_underfilled")
        add(f"{s}_controls_underfilled", True, F.coalesce(few, F.lit(False)).cast("double"), ~few, f"{s} frequency-matched controls underfilled")
    above = [
        ("mean_net_return_positive", "mean_net_return_pct", 0.0, "mean net return not positive", both),
        ("mean_ci_above_zero", "mean_ci_low", 0.0, "mean return CI lower bound not above zero", both),
        ("lift_threshold", "lift_bps", None, f"lift below {spec.minimum_lift_bps:g} bps", both),
        ("lift_ci_above_zero", "lift_ci_low", 0.0, "lift CI lower bound not above zero", both),
        ("median_ticker_lift_positive", "median_ticker_lift_bps", 0.0, "median ticker-level lift not positive", both),
        ("pct_tickers_positive_lift", "pct_tickers_positive_lift", None, None, both),
        ("first_half_positive", "first_half_mean_return_pct", 0.0, "first-half mean net return not positive", ("holdout",)),
        ("second_half_positive", "second_half_mean_return_pct", 0.0, "second-half mean net return not positive", ("holdout",)),
    ]
    least = {"lift_bps": spec.minimum_lift_bps, "pct_tickers_positive_lift": spec.minimum_positive_lift_share}
    for name, c, zero, text, splits in above:
        for s in splits:
            told = f"{s} {text}" if text else f"fewer than {spec.minimum_positive_lift_share:.0%} of {s} tickers have positive lift"
            add(f"{s}_{name}", False, of(s, c), of(s, c) > zero if zero is not None else of(s, c) >= least[c], told)
    return out


def evidence_gates(found: DataFrame, spec: EvidenceSpec = EvidenceSpec(), manifest_ok: bool = True, events: tuple[str, ...] = EVENTS) -> DataFrame:
    """One row per event type and gate: value, passed, reason, the event type's classification and the study's.

    A split without a row fails its gates. An event type whose sample gates fail is inconclusive; one whose return gates all pass is supported; one
    with a return figure that cannot be computed is inconclusive; any other is rejected. The study is rejected if one type is, else inconclusive
    if one is or the manifest is broken.
    """
    spark = found.sparkSession
    sides = found.groupBy("event_type").agg(*[F.max(F.when(F.col("split") == s, F.struct(*found.columns))).alias(s) for s in ("validation", "holdout")])
    wide = spark.createDataFrame([(e,) for e in events], "event_type string").join(sides, "event_type", "left")
    gates = _gates(spec)
    samples = [g[3] for g in gates if g[1]]
    returns = [(g[2], g[3]) for g in gates if not g[1]]
    every = lambda columns: F.forall(F.array(*columns), lambda x: x)
    label = (
        F.when(~every(samples), "inconclusive").when(every([p for _, p in returns]), "supported")
        .when(~every([v.isNotNull() for v, _ in returns]), "inconclusive").otherwise("rejected")
    )
    rows = F.array(*[
        F.struct(F.lit(n).alias("gate"), v.cast("double").alias("value"), p.alias("passed"), F.when(~p, F.lit(t)).alias("reason")) for n, _, v, p, t in gates
    ])
    typed = wide.select("event_type", label.alias("classification"), rows.alias("gates"))
    has = lambda c: F.bool_or(F.col("classification") == c)
    whole = typed.agg(F.when(F.lit(not manifest_ok), "inconclusive").when(has("rejected"), "rejected").when(has("inconclusive"), "inconclusive").otherwise("supported").alias("overall"))
    return typed.crossJoin(F.broadcast(whole)).select("event_type", F.inline("gates"), "classification", "overall")
