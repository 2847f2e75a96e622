"""Ordered series cut into bounded blocks.

A series (one ticker, one ticker and split, ...) may hold a large share of all rows, so no
window here is partitioned by the series key alone. Rows are numbered per series with a
bucketed two-level count, cut into blocks of ``BLOCK_ROWS`` positions, and a block receives
copies of the neighbouring rows its look-back and look-ahead need (``own`` is false on
copies). Every later window is partitioned by (series, block): one exchange serves them all,
and the largest task is one block whatever the skew.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
SUB_ROWS = 2_048          # rows of a running sum; its scale (1 - a) ** -SUB_ROWS stays a finite double for a <= 0.25
HALO_ROWS = 10 * SUB_ROWS  # look-back after which the past weighs exactly 0.0 as a double, for a >= 2 / 51
FREE = -(2**62)           # state "nothing is held"


def number_rows(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", bucket_seconds: int = 86_400 * 128, size: str | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """Add ``pos``, the 0-based row number per series in ``ts`` order (``ts`` unique per series, or ordered by ``ties``),
    and under the name ``size`` the number of rows of the series.

    Rows are ranked inside calendar buckets; the bucket offsets come from a table of one row per
    (series, bucket), whose size depends on the calendar span and not on the data volume.
    """
    keys = list(keys)
    bucketed = df.withColumn("_bucket", F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / bucket_seconds))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
            *([F.sum("_n").over(Window.partitionBy(*keys)).alias(size)] if size else []),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts, *ties)
    return (
        bucketed.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn("pos", F.col("_base") + F.col("_rank") - 1)
        .drop("_bucket", "_base", "_rank")
    )


def place_rows(
    df: DataFrame, keys: Sequence[str], before: int = 0, after: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Send numbered rows to their block and, as copies, to the blocks that look back or ahead to them."""
    if max(before, after) > block_rows:
        raise ValueError("look-back and look-ahead must fit in one block")
    home = F.floor(F.col("pos") / block_rows)
    offset = F.col("pos") % block_rows
    targets = [home]
    if before:
        targets.append(F.when(offset >= block_rows - before, home + 1))
    if after:
        targets.append(F.when((offset < after) & (home > 0), home - 1))
    spread = df.withColumn("_home", home)
    if len(targets) > 1:
        spread = spread.withColumn("blk", F.explode(F.array_compact(F.array(*targets))))
    else:
        spread = spread.withColumn("blk", F.col("_home"))
    return (
        spread.withColumn("own", F.col("blk") == F.col("_home"))
        .drop("_home")
        .repartition(*[F.col(k) for k in keys], F.col("blk"))
    )


def lay_out(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    before: int = 0,
    after: int = 0,
    block_rows: int = BLOCK_ROWS,
    size: str | None = None,
) -> DataFrame:
    """Number the rows of each series and place them in blocks."""
    return place_rows(number_rows(df, keys, ts, size=size), keys, before, after, block_rows)


def block_window(keys: Sequence[str]):
    return Window.partitionBy(*keys, "blk").orderBy("pos")


def owned(df: DataFrame) -> DataFrame:
    """Drop the copies and the block column."""
    return df.filter("own").drop("own", "blk")


def smooth(df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[Column, float]]) -> DataFrame:
    """Recursive averages ``y = (1 - a) y' + u`` of several inputs ``{name: (u, a)}`` in one pass.

    A running sum gives the average inside a sub-block. What all earlier sub-blocks carry in is summed at the first row of the
    sub-block, each end weighted by its distance, as far back as that weight is no zero double. So the result is the plain
    recursion's, also where an input stays at zero and only the carry is left.
    """
    j = F.col("_j")
    df = df.withColumn("_sub", F.floor(F.col("pos") / SUB_ROWS)).withColumn("_j", F.col("pos") % SUB_ROWS)
    running = (
        Window.partitionBy(*keys, "blk", "_sub").orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    along = block_window(keys)
    parts = {
        f"_p_{name}": F.coalesce(F.sum(u * F.pow(F.lit(1 - a), -j)).over(running), F.lit(0.0)) * F.pow(F.lit(1 - a), j)
        for name, (u, a) in specs.items()
    }
    df = df.withColumns(parts)
    entering = {f"_n_{name}": carry_in(f"_p_{name}", a, along) for name, (_, a) in specs.items()}
    df = df.withColumns(entering)
    carried = {f"_c_{name}": F.first(f"_n_{name}").over(running) for name in specs}
    df = df.withColumns(carried)
    out = {
        name: F.col(f"_p_{name}") + F.when(F.col("_sub") > 0, F.col(f"_c_{name}")).otherwise(F.lit(0.0)) * F.pow(F.lit(1 - a), j + 1)
        for name, (_, a) in specs.items()
    }
    return df.withColumns(out).drop("_sub", "_j", *parts, *entering, *carried)


def carry_in(part: str, a: float, along) -> Column:
    """What the ends of the earlier sub-blocks leave at the first row of a sub-block (elsewhere without meaning)."""
    total, back, weight = F.lit(0.0), 1, 1.0
    while weight > 0.0:
        total = total + F.coalesce(F.lag(part, back).over(along), F.lit(0.0)) * F.lit(weight)
        back, weight = back + SUB_ROWS, weight * (1 - a) ** SUB_ROWS
    return total


def running_total(df: DataFrame, keys: Sequence[str], totals: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running sums from the series start over numbered rows: block totals carried into block sums."""
    return _running(df, keys, totals, F.sum, F.lit(0.0), lambda a, b: a + b, block_rows)


def running_peak(df: DataFrame, keys: Sequence[str], peaks: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running maxima from the series start over numbered rows."""
    return _running(df, keys, peaks, F.max, F.lit(None).cast("double"), lambda a, b: F.greatest(a, b), block_rows)


def _running(df, keys, columns, function, start, combine, block_rows):
    keys = list(keys)
    block = F.floor(F.col("pos") / block_rows)
    df = df.withColumns({f"_x_{n}": c for n, c in columns.items()}).withColumn("_blk", block)
    inside = Window.partitionBy(*keys, "_blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        df.groupBy(*keys, "_blk")
        .agg(*[function(f"_x_{n}").alias(f"_t_{n}") for n in columns])
        .select(
            *keys, "_blk",
            *[F.coalesce(function(f"_t_{n}").over(earlier), start).alias(f"_b_{n}") for n in columns],
        )
    )
    local = df.withColumns({f"_l_{n}": function(f"_x_{n}").over(inside) for n in columns})
    joined = local.join(carried, [*keys, "_blk"])
    out = joined.withColumns({n: combine(F.col(f"_b_{n}"), F.col(f"_l_{n}")) for n in columns})
    drop = [f"{p}{n}" for n in columns for p in ("_x_", "_l_", "_b_")]
    return out.drop("_blk", *drop)
