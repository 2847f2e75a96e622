"""Balanced shards by longest-processing-time scheduling over groups of equal texts."""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import Scratch

#: Items that the schedule holds for each shard; its imbalance is about 1/PARTS of a shard at most, besides single large groups.
PARTS = 1024
#: Cells in which the rows of a shard are numbered.
CELLS = 512


def longest_first(sizes: list[int], shards: int) -> list[int]:
    """The shard of every item: in descending size (ties in the given order) each goes to the least-loaded shard (ties: lowest number)."""
    loads = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, s = loads[0]
        out[i] = s
        heapq.heapreplace(loads, (load + sizes[i], s))
    return out


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Narrow rows: id, size (UTF-8 bytes plus 1), CRC-32 and group (hash of the text). Null texts count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t).cast("bigint") + 1).alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("group"))


def assign(docs: DataFrame, scratch: Scratch, shards: int = 16, parts: int = PARTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; rows of equal text share a shard, slots are gapless from 0.

    Sizes are summed per group before anything is gathered. Groups above 1/(shards*parts) of all bytes (at most shards*parts of them) are
    items of the schedule themselves; the others are dealt into as many buckets by hash, and each bucket is an item. So the
    driver's heap sees at most 2*shards*parts items whatever the input. Two texts whose 64-bit hashes agree would share a shard, which
    breaks no rule. An empty table gives no rows; null ids are kept, repeated rows are numbered each.
    """
    spark, items = docs.sparkSession, shards * parts
    rows = scratch.keep(sized(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.pmod("group", F.lit(items)).cast("int")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("group", "bucket").agg(F.sum("size").alias("size"))
    large = F.col("size").cast("decimal(38,0)") * items > F.lit(total).cast("decimal(38,0)")
    loads = groups.groupBy(F.when(large, F.col("group")).alias("group"), F.when(~large, F.col("bucket")).alias("bucket")).agg(F.sum("size").alias("size")).collect()
    loads.sort(key=lambda r: (r["group"] is None, r["group"] or 0, r["bucket"] or 0))
    placed = list(zip(loads, longest_first([r["size"] for r in loads], shards)))
    by_group = spark.createDataFrame([(r["group"], s) for r, s in placed if r["group"] is not None], "group bigint, group_shard int")
    by_bucket = spark.createDataFrame([(r["bucket"], s) for r, s in placed if r["bucket"] is not None], "bucket int, bucket_shard int")
    out = rows.join(F.broadcast(by_group), "group", "left").join(F.broadcast(by_bucket), "bucket", "left")
    out = out.withColumn("shard", F.coalesce("group_shard", "bucket_shard")).withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(CELLS)).cast("int"))
    before = out.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "row")) - 1
    return out.withColumn("within", within).join(F.broadcast(before), ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within")).alias("slot"))
