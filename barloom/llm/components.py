"""Connected components of an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label`` for every node with an edge to another (columns ``a`` and ``b``, whole numbers); label is the smallest node of its component.

    Alternating large-star and small-star steps: each is an aggregate and a join, so a node with very many edges is summed up before
    it is shuffled, and no component is gathered. A step's edges are written to the scratch folder; the number of steps grows with the
    logarithm of the longest path.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).filter("a <> b").distinct())
    mark = signature(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        after = scratch.keep(small)
        scratch.drop(now)
        now, before, mark = after, mark, signature(after)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
