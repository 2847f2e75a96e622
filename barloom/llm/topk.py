"""Exact top-k by inner product with MaxScore over dimension postings.

Every dimension is a term. In a block of vectors, the posting of a term holds its components; its score bound for a query is the
largest contribution that the block allows. Terms are split by their bounds: those whose bounds together stay below the query's
k-th score so far are non-essential. Only vectors to which an essential term contributes are traversed (all, while the k-th score is not
positive); the others are probed term by term in descending bound while a vector can still reach the k-th score.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that one pass over the vectors holds; more are asked in further passes.
BLOCK_QUERIES = 8192
#: Vectors whose postings a task holds at a time.
BLOCK_VECTORS = 4096
#: Scores that may reach this are summed as Python integers.
LARGEST = float(1 << 62)

RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


class Postings:
    """Components of a block by dimension, with their bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.terms = ids, np.ascontiguousarray(vectors.T)
        self.low, self.high = self.terms.min(axis=1), self.terms.max(axis=1)
        self.largest = max(-float(self.low.min()), float(self.high.max()))

    def search(self, own: int, query: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Puts what belongs to the k best into ``best``, a heap of (score, -vec_id)."""
        terms = np.flatnonzero(query[:len(self.terms)])
        weights, held, low, high = query[terms], self.terms, self.low, self.high
        if self.largest * np.abs(weights.astype(float)).sum() >= LARGEST:
            weights, held, low, high = (x.astype(object) for x in (weights, held, low, high))
        bounds = np.maximum(np.maximum(weights * low[terms], weights * high[terms]), 0)
        order = np.argsort(bounds, kind="stable")
        below = np.cumsum(bounds[order])
        floor = best[0][0] if len(best) == k else None
        # A vector without any positive part scores 0 or less: up to a floor of 0 such vectors count too, and none can be passed over.
        every = floor is None or floor <= 0
        split = 0 if every else int(np.searchsorted(below, floor, side="left"))
        essential, others = order[split:], order[:split][::-1]
        if not len(essential) and not every:
            return
        score = np.zeros(len(self.ids), held.dtype)
        touched = np.full(len(self.ids), every)
        for t in essential:
            part = held[terms[t]] * weights[t]
            score += part
            touched |= part > 0
        at = np.flatnonzero(touched & (self.ids != own))
        score, rest = score[at], int(below[split - 1]) if split else 0
        for t in others:
            if floor is not None:
                alive = score + rest >= floor
                at, score = at[alive], score[alive]
            if not len(at):
                return
            score = score + held[terms[t]][at] * weights[t]
            rest -= int(bounds[t])
        if len(score) > k:
            keep = score >= (np.sort(score) if score.dtype == object else np.partition(score, len(score) - k))[len(score) - k]
            at, score = at[keep], score[keep]
        for s, i in zip(score.tolist(), self.ids[at].tolist()):
            if len(best) < k:
                heapq.heappush(best, (s, -i))
            elif (s, -i) > best[0]:
                heapq.heapreplace(best, (s, -i))


def scaled(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vec_id`` and the components floor(scale * x) as integers.

    Left out: null vectors and ids, and vectors with a null or non-finite component. Empty vectors stay. A finite component that is no
    bigint when scaled is an error, as in SQL; so is a result's score that is none.
    """
    raw = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    good = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    v = F.transform(raw, lambda x: F.when(F.abs(x) < float(1 << 63), F.floor(x)).otherwise(F.raise_error(F.lit("a scaled component is beyond bigint")).cast("bigint")))
    return df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(F.coalesce(good, F.lit(False)), v).alias("v")).filter("vec_id is not null and v is not null")


def matrix(rows: list, width: int) -> np.ndarray:
    """Rows of equal or different lengths; missing components are 0."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Postings]:
    held_ids, held = [], []
    for batch in batches:
        held_ids += batch.column(0).to_pylist()
        column = batch.column(1)
        values, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
        held += [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        while len(held) >= BLOCK_VECTORS:
            yield postings(held_ids[:BLOCK_VECTORS], held[:BLOCK_VECTORS])
            held_ids, held = held_ids[BLOCK_VECTORS:], held[BLOCK_VECTORS:]
    if held:
        yield postings(held_ids, held)


def postings(ids: list, vectors: list) -> Postings:
    return Postings(np.asarray(ids, np.int64), matrix(vectors, max(1, max(map(len, vectors)))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of every query's k best vectors (all, if fewer), its own id left out; ties to smaller ids.

    Both tables have ``vec_id`` and integer arrays ``v``. A block of queries goes to all tasks; a task keeps k results a query over all its
    blocks of vectors, and the tasks' results are merged. Vectors of different lengths meet in their common components. Rows with
    equal ids are ranked each; a query id that repeats is asked once, with its smallest vector.
    """
    spark = vectors.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, math.ceil(queries.count() / block_queries))
    found = None
    for n in range(blocks):
        asked = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n)
        sent = spark.sparkContext.broadcast([(r.vec_id, np.asarray(r.v, np.int64)) for r in asked.collect()])

        def search(batches, sent=sent):
            best: list[list[tuple[int, int]]] = [[] for _ in sent.value]
            for block in blocks_of(batches):
                for (own, query), heap in zip(sent.value, best):
                    block.search(own, query, heap, k)
            rows = [(q, -i, s) for (q, _), heap in zip(sent.value, best) for s, i in heap]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], names=RESULT.names)

        part = vectors.mapInArrow(search, RESULT)
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
