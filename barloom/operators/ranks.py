"""Percent ranks with average ties (nulls do not take part)."""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .blocks import BLOCK_ROWS
from .sorted_groups import groups_of


def last_bar_rank(frame: DataFrame, keys: list[str], column: str, order: str = "pos") -> DataFrame:
    """Percent rank of each series' last value among its whole frame: one row per series.

    The last value is found by a map-side combined aggregate and joined back, and the two counts
    combine map-side too, so a hot series never gathers in one task.
    """
    last = frame.groupBy(*keys).agg(F.max_by(column, order).alias("_last"))
    below, same = F.col(column) < F.col("_last"), F.col(column) == F.col("_last")
    return (
        frame.select(*keys, column).join(last, keys)
        .groupBy(*keys)
        .agg(
            F.count_if(below).alias("_below"), F.count_if(same).alias("_same"),
            F.count(column).alias("_all"), F.first("_last").alias("_last"),
        )
        .select(*keys, F.when(F.col("_last").isNotNull(), (F.col("_below") + (F.col("_same") + 1) / 2) / F.col("_all")).alias(f"{column}_rank"))
    )


def add_frame_rank(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Percent rank of the last value within a bounded frame (one block per series), on every row of it."""
    frame = Window.partitionBy(*keys, "blk")
    x, last = F.col(column), F.col("_last")
    counted = df.withColumn("_last", F.max_by(column, "pos").over(frame)).withColumns(
        {"_below": F.count_if(x < last).over(frame), "_same": F.count_if(x == last).over(frame), "_all": F.count(x).over(frame)}
    )
    rank = F.when(last.isNotNull(), (F.col("_below") + (F.col("_same") + 1) / 2) / F.col("_all"))
    return counted.withColumn(f"{column}_rank", rank).drop("_last", "_below", "_same", "_all")


def expanding_rank(df: DataFrame, keys: list[str], column: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Percent rank of every value among all values of its series so far, itself included, as ``{column}_rank``.

    ``df`` is a written table (it is read more than once) with ``pos``, whole numbers rising along a series. The smaller earlier values of a row are counted in three parts, so no task
    ever holds a series: those of its own block of ``block_rows`` positions, by merge counting; those of earlier blocks in lower value
    buckets, from a grid of blocks by buckets with running sums; those of earlier blocks in its own bucket, by merge counting
    among the bucket's distinct values by block. Buckets are the ranges of a range partitioning by value, about a block of rows each; a value that
    repeats counts once a block there, however many rows hold it. Null values have a null rank and take no part.
    """
    keys = list(keys)
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    block = F.floor(F.col("pos") / block_rows)
    rows = df.withColumn("_blk", block)
    known = rows.filter(F.col(column).isNotNull()).select(*[F.col(k).alias(n) for k, n in names.items()], "_blk", "pos", F.col(column).cast("double").alias("_v"))
    k = list(names.values())
    counted = known.groupBy(*k, "_blk", "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = counted.repartitionByRange(max(1, math.ceil(df.count() / block_rows)), *k, "_v")
    bucketed = settle(ranged.withColumn("_bkt", F.spark_partition_id()))  # written: the bounds are drawn once

    # The grid of a series: blocks by buckets, with sums over lower buckets and then over earlier blocks.
    cells = bucketed.groupBy(*k, "_blk", "_bkt").agg(F.sum("_n").alias("_n"))
    blocks, buckets = cells.select(*k, "_blk").distinct(), cells.select(*k, "_bkt").distinct()
    lower = Window.partitionBy(*k, "_blk").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*k, "_bkt").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    grid = (
        blocks.join(buckets, k).join(cells, [*k, "_blk", "_bkt"], "left")
        .withColumn("_lower", zero(F.sum("_n").over(lower)))
        .withColumn("_below_far", zero(F.sum("_lower").over(earlier)))
        .filter(F.col("_n").isNotNull()).select(*k, "_blk", "_bkt", "_below_far")
    )
    # Inside a bucket: values of earlier blocks.
    near = merge_counts(bucketed, [*k, "_bkt"], "_blk", "_v", "_n")
    same = F.sum("_n").over(Window.partitionBy(*k, "_v").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))
    far = near.withColumn("_same_far", zero(same)).join(grid, [*k, "_blk", "_bkt"]).select(
        *k, "_blk", "_v", (F.col("_below_far") + F.col("_below")).alias("_below_far"), "_same_far")
    # Inside a block: earlier rows.
    inside = merge_counts(known.withColumn("_n", F.lit(1).cast("bigint")), [*k, "_blk"], "pos", "_v", "_n", extra=True)
    before = Window.partitionBy(*k).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = known.groupBy(*k, "_blk").agg(F.count(F.lit(1)).alias("_t")).select(*k, "_blk", zero(F.sum("_t").over(before)).alias("_all_far"))
    below, ties = F.col("_below_far") + F.col("_below"), F.col("_same_far") + F.col("_same") + 1
    ranked = inside.join(far, [*k, "_blk", "_v"]).join(totals, [*k, "_blk"]).select(
        *[F.col(n).alias(c) for c, n in names.items()], "pos", ((below + (ties + 1) / 2) / (F.col("_all_far") + F.col("_seen") + 1)).alias(f"{column}_rank"))
    return rows.drop("_blk").join(ranked, [*keys, "pos"], "left")


def merge_counts(df: DataFrame, groups: list[str], order: str, value: str, weight: str, extra: bool = False) -> DataFrame:
    """Adds ``_below``: the weight of the group's rows that come earlier in ``order`` and hold a smaller value.

    With ``extra`` also ``_same`` (earlier rows of an equal value) and ``_seen`` (all earlier rows). A task holds one group at a time.
    """
    fields = [*groups, order, value, weight]
    added = ["_below", "_same", "_seen"] if extra else ["_below"]
    schema = T.StructType([*[df.schema[f] for f in fields], *[T.StructField(a, T.LongType()) for a in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups_of(batches, len(groups)):
            o, v, w = (table.column(f).to_numpy() for f in (order, value, weight))
            for name, c in zip(added, earlier_smaller(o, v, w, extra)):
                table = table.append_column(name, pa.array(c, pa.int64()))
            yield from table.combine_chunks().to_batches()

    return df.select(*fields).repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, schema)


def earlier_smaller(order: np.ndarray, value: np.ndarray, weight: np.ndarray, extra: bool = False) -> tuple[np.ndarray, ...]:
    """For every element the weight of those with a smaller ``order`` and a smaller ``value``; with ``extra`` also with an equal value, and of all.

    Merge counting: two elements of different order first differ in one bit of their order's rank. At every bit, the halves of a pair of
    runs are compared in the order of their values by one running sum.
    """
    ranks = np.unique(order, return_inverse=True)[1]
    values = np.unique(value, return_inverse=True)[1]
    weight = weight.astype(np.int64)
    by_value = np.argsort(values, kind="stable")
    below, same, seen = (np.zeros(len(order), np.int64) for _ in range(3))
    for bit in range(int(ranks.max(initial=0)).bit_length()):
        run = ranks[by_value] >> (bit + 1)
        at = by_value[np.argsort(run, kind="stable")]  # by run, then value
        run, v, right = ranks[at] >> (bit + 1), values[at], (ranks[at] >> bit) & 1
        sums = np.concatenate([[0], np.cumsum(np.where(right == 0, weight[at], 0))])
        first = np.flatnonzero(np.diff(run, prepend=-1) != 0)
        start = np.repeat(first, np.diff(first, append=len(at)))
        tie = np.flatnonzero((np.diff(run, prepend=-1) != 0) | (np.diff(v, prepend=-1) != 0))
        tie_start, tie_end = (np.repeat(x, np.diff(tie, append=len(at))) for x in (tie, np.append(tie[1:], len(at))))
        later = right == 1
        below[at[later]] += (sums[tie_start] - sums[start])[later]
        if extra:
            end = np.repeat(np.append(first[1:], len(at)), np.diff(first, append=len(at)))
            same[at[later]] += (sums[tie_end] - sums[tie_start])[later]
            seen[at[later]] += (sums[end] - sums[start])[later]
    return (below, same, seen) if extra else (below,)
