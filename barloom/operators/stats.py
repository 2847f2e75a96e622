"""Group statistics that stay exact and spread out when one group holds most rows."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sorted_groups import groups_of

BUCKETS_PER_UNIT = 200.0


def _value_bucket(v: Column) -> Column:
    """Order-preserving coarse bucket of a number; a few thousand buckets cover all magnitudes."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * BUCKETS_PER_UNIT)


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group (nulls ignored), without gathering a group in one task.

    Equal values are counted map-side; bucket totals give the rank at which every bucket starts, so
    only rows whose rank is asked for leave their (group, bucket).
    """
    groups = list(groups)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", _value_bucket(F.col("_v")))
    )
    below = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    starts = (
        counted.groupBy(*groups, "_b").agg(F.sum("_n").alias("_t"))
        .select(*groups, "_b", F.coalesce(F.sum("_t").over(below), F.lit(0)).alias("_base"), F.sum("_t").over(whole).alias("_all"))
    )
    inside = Window.partitionBy(*groups, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.withColumn("_cum", F.sum("_n").over(inside))
        .join(starts, [*groups, "_b"])
        .withColumn("_hi", F.col("_base") + F.col("_cum") - 1)
        .withColumn("_lo", F.col("_hi") - F.col("_n") + 1)
    )
    out = []
    for name, q in quantiles.items():
        target = F.lit(q) * (F.col("_all") - 1)
        low, high = F.floor(target), F.ceil(target)
        holds = lambda k: (F.col("_lo") <= k) & (F.col("_hi") >= k)
        a = F.max(F.when(holds(low), F.col("_v")))
        b = F.max(F.when(holds(high), F.col("_v")))
        part = F.max(target - low)
        out.append(F.when(a == b, a).otherwise(a + (b - a) * part).alias(name))  # also where both are infinite
    return ranked.groupBy(*groups).agg(*out)


def group_metrics(
    df: DataFrame, groups: Sequence[str], value: str, minimum: int, ticker: str = "ticker"
) -> DataFrame:
    """Event and ticker counts, moments, quantiles and the mean and median of per-ticker means."""
    groups = list(groups)
    v = F.col(value)
    per_ticker = df.groupBy(*groups, ticker).agg(
        F.count(v).alias("_n"), F.avg(v).alias("_m"), F.var_pop(v).alias("_v"),
        F.count_if(v > 0).alias("_pos"), F.min(v).alias("_min"), F.max(v).alias("_max"),
        F.count(F.lit(1)).alias("_rows"),
    )
    n = F.sum("_n")
    mean = F.sum(F.col("_n") * F.col("_m")) / n
    spread = F.sum(F.col("_n") * (F.col("_v") + F.col("_m") * F.col("_m"))) / n - mean * mean
    moments = per_ticker.groupBy(*groups).agg(
        F.sum("_rows").alias("event_count"),
        F.count(F.lit(1)).alias("unique_tickers"),
        mean.alias("mean_net_return_pct"),
        (F.sum("_pos") / n * 100.0).alias("positive_return_rate_pct"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("standard_deviation_pct"),
        F.min("_min").alias("minimum_net_return_pct"),
        F.max("_max").alias("maximum_net_return_pct"),
        F.avg("_m").alias("mean_ticker_event_return_pct"),
        F.median("_m").alias("median_ticker_event_return_pct"),
    )
    quantiles = exact_quantiles(
        df, groups, value,
        {"p25_net_return_pct": 0.25, "median_net_return_pct": 0.5, "p75_net_return_pct": 0.75},
    )
    status = F.when(F.col("event_count") >= minimum, "sufficient_sample").otherwise("insufficient_sample")
    return moments.join(quantiles, groups, "left").withColumn("sample_status", status)


METRICS = [
    "event_count", "unique_tickers", "mean_net_return_pct", "median_net_return_pct", "positive_return_rate_pct",
    "standard_deviation_pct", "p25_net_return_pct", "p75_net_return_pct", "minimum_net_return_pct",
    "maximum_net_return_pct", "mean_ticker_event_return_pct", "median_ticker_event_return_pct", "sample_status",
]


def on_scaffold(scaffold: DataFrame, metrics: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Every scaffold row, empty groups with zero counts and ``insufficient_sample``."""
    return (
        scaffold.join(metrics, list(groups), "left")
        .withColumn("event_count", F.coalesce("event_count", F.lit(0)))
        .withColumn("unique_tickers", F.coalesce("unique_tickers", F.lit(0)))
        .withColumn("sample_status", F.coalesce("sample_status", F.lit("insufficient_sample")))
    )


#: Replicates that a task draws.
REPLICATES = 250


def draws(seed: int, replicate: int, size: int) -> np.ndarray:
    """The members that a replicate takes, with replacement: 32-bit words of md5 over ``seed:replicate:number``, modulo the size."""
    words = b"".join(hashlib.md5(f"{seed}:{replicate}:{i}".encode()).digest() for i in range(-(-size // 4)))
    return np.frombuffer(words, ">u4")[:size] % size


def resampled(clusters: DataFrame, by: Sequence[str], sums: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """``by, replicate`` and the sums of every resample of a group's clusters, all columns over the same draws.

    ``clusters`` holds one row per (by, cluster), collapsed beforehand. A group's clusters go once to each of its blocks of ``REPLICATES``
    replicates; there a replicate counts how often it draws each cluster, and its sums are one product of counts and values. Rows of
    replicates by clusters are never made. Clusters are numbered in the order of their names.
    """
    by, sums = list(by), list(sums)
    last = replicates - 1
    spread = clusters.select(*by, F.explode(F.sequence(F.lit(0), F.lit(last // REPLICATES))).alias("_part"), "cluster", *[F.col(c).cast("double").alias(c) for c in sums])
    schema = T.StructType([*[clusters.schema[c] for c in by], T.StructField("replicate", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in sums]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in groups_of(batches, len(by) + 1):
            values = np.column_stack([table.column(c).to_numpy() for c in sums])
            first = key[-1] * REPLICATES
            taken = range(first, min(first + REPLICATES, last + 1))
            found = np.array([np.bincount(draws(seed, r, len(values)), minlength=len(values)) @ values for r in taken])
            keys = [table.column(c).combine_chunks().take(pa.array([0] * len(taken))) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(taken, pa.int32()), *[pa.array(found[:, i]) for i in range(len(sums))]], names=schema.names)

    return spread.repartition(*by, "_part").sortWithinPartitions(*by, "_part", "cluster").mapInArrow(run, schema)


def interval(replicated: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """The 2.5th and 97.5th percentiles of a figure over the replicates in which it can be computed."""
    ends = F.percentile("_x", F.array(F.lit(0.025), F.lit(0.975)))
    return replicated.withColumn("_x", value).filter(F.col("_x").isNotNull()).groupBy(*by).agg(ends.alias("_ci"), F.count(F.lit(1)).alias("replicates")).select(
        *by, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"), "replicates")


def cluster_bootstrap(
    clusters: DataFrame, by: Sequence[str], numerator: str, denominator: str, replicates: int, seed: int
) -> DataFrame:
    """Percentile interval of a pooled mean under resampling of clusters with replacement, with the mean itself."""
    by = list(by)
    mean = F.try_divide(numerator, denominator)
    point = clusters.groupBy(*by).agg(F.try_divide(F.sum(numerator), F.sum(denominator)).alias("estimate"), F.count(F.lit(1)).alias("clusters"))
    return point.join(interval(resampled(clusters, by, [numerator, denominator], replicates, seed), by, mean), by, "left")


def lift_bootstrap(clusters: DataFrame, by: Sequence[str], replicates: int, seed: int, scale: float = 100.0) -> DataFrame:
    """Difference of two pooled means, and its interval over resamples of the clusters that both sides hold.

    ``clusters`` has ``sum, n`` of one side and ``other_sum, other_n`` of the other, missing or 0 where a side lacks the cluster. The estimate pools
    all clusters of each side; a resample takes both sides' rows of every cluster drawn. Without a common cluster all is null.
    """
    by, columns = list(by), ["sum", "n", "other_sum", "other_n"]
    filled = clusters.select(*by, "cluster", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    both = (F.col("n") > 0) & (F.col("other_n") > 0)
    lift = lambda f: (F.try_divide(f("sum"), f("n")) - F.try_divide(f("other_sum"), f("other_n"))) * scale
    point = filled.groupBy(*by).agg(lift(F.sum).alias("_all"), F.count_if(both).alias("common_clusters"))
    point = point.select(*by, F.when(F.col("common_clusters") > 0, F.col("_all")).alias("lift"), "common_clusters")
    return point.join(interval(resampled(filled.filter(both), by, columns, replicates, seed), by, lift(F.col)), by, "left")
