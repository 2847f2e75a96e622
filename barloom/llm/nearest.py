"""Approximate nearest neighbours by cosine: lists of vectors around centres, scanned by an adaptive dimension scan.

Unit vectors are turned by a random rotation, so that any block of columns is a fair sample of a distance. A query scans the lists
around its nearest centres column block by column block; a candidate whose partial distance, scaled up to all columns, is significantly beyond
the query's k-th best is given up. What survives is scored exactly on the original vectors.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import Scratch

from .vectors import matrices, usable, width_of

#: Lists at most, and components of all centres at most; both bound what is sent to every task.
LISTS, CENTRE_COMPONENTS = 16_384, 1 << 22
#: Distinct vectors a centre is fitted on (a bounded sample by hash), and rounds of the fit.
SAMPLE, ROUNDS = 64, 10
#: Share of true neighbours within the sample that the probed lists must hold; queries and vectors of that measurement.
TARGET, MEASURED, AMONG = 0.98, 256, 16_384
#: Candidates and queries that meet in one block.
CHUNK, ASKED = 8_192, 16_384
#: Columns added to a partial distance at a time, candidates scanned before the k-th best is looked at again.
COLUMNS, STRIDE = 16, 1_024
#: Deviations of the test that gives a candidate up.
SURE = 2.1
SEED = 20_240_501


@dataclass
class Index:
    """Centres (unit rows), the rotation, lists a query probes, and the written table ``list, ids, v`` of distinct vectors."""

    width: int
    centres: np.ndarray
    rotation: np.ndarray
    probes: int
    k: int
    table: DataFrame


def units(m: np.ndarray) -> np.ndarray:
    """Rows over their lengths, by way of their largest components: neither overflows nor underflows. Zero rows stay."""
    largest = np.abs(m).max(axis=1, initial=0.0, keepdims=True)
    m = m / np.where(largest > 0, largest, 1)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(length > 0, length, 1)


def cosines(query: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Cosine of the query with every row in double precision; equal rows give equal values wherever they stand."""
    q, m = query / np.abs(query).max(), m / np.abs(m).max(axis=1, keepdims=True)
    return (m * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((m * m).sum(axis=1)))


def rotated_by(width: int) -> np.ndarray:
    """A random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, width)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v`` of vectors with a direction, components as doubles."""
    directed = F.coalesce(F.exists(F.col(vector), lambda x: x != 0), F.lit(False))
    return df.filter(usable(vector) & directed & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))


def fitted_centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres by spherical k-means; a centre that loses all its vectors takes the one that fits worst."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        own, fit = nearest_centre(sample, centres)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        total[empty] = sample[np.argsort(fit, kind="stable")[:len(empty)]]
        centres = units(total)
    return centres


def nearest_centre(m: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, fit = np.zeros(len(m), np.int64), np.zeros(len(m))
    for at in range(0, len(m), 2048):
        s = m[at:at + 2048] @ centres.T
        own[at:at + 2048] = s.argmax(axis=1)
        fit[at:at + 2048] = s.max(axis=1)
    return own, fit


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int) -> int:
    """Lists to probe so that ``TARGET`` of the true neighbours of sampled queries among the sample lie in them.

    Neighbours among all vectors are nearer than those among a sample, so the whole table is found with that share or a higher one.
    """
    among = sample[:AMONG]
    own, _ = nearest_centre(among, centres)
    places = []
    for i in range(min(MEASURED, len(among))):
        near = among @ among[i]
        near[i] = -np.inf
        best = np.argpartition(-near, min(k, len(near) - 1))[:k] if len(near) > k else np.flatnonzero(np.isfinite(near))
        rank = np.empty(len(centres), np.int64)
        rank[np.argsort(-(centres @ among[i]), kind="stable")] = np.arange(len(centres))
        places.append(rank[own[best]])
    found = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    return int(found[min(len(found) - 1, math.ceil(TARGET * len(found)))]) + 1 if len(found) else 1


def build(df: DataFrame, scratch: Scratch, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5) -> Index | None:
    """The index of all vectors with a direction; None where there is none.

    Equal vectors are indexed once, with the k + 1 smallest of their ids: no result can name another. The window's limit is applied before
    its shuffle, so a vector that a third of all rows share sends k + 1 rows a task. Centres are fitted on ``SAMPLE`` distinct
    vectors a list, drawn by hash; their number grows with the root of the vectors up to ``LISTS``. Every vector is then put
    into the list of its nearest centre.
    """
    width = width_of(df, vector)
    order = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = valid(df, vec_id, vector).distinct().withColumn("at", order).filter(F.col("at") <= k + 1)
    distinct = scratch.keep(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = distinct.count()
    if not n:
        return None
    lists = max(1, min(round(math.sqrt(n)), LISTS, CENTRE_COMPONENTS // width))
    drawn = distinct.orderBy(F.xxhash64("v"), "v").limit(min(lists * SAMPLE, max(lists, (1 << 25) // width))).select("v").toArrow()
    sample = units(np.vstack([m for batch in drawn.to_batches() for _, m, _ in matrices(batch, 0, width)]))
    centres = fitted_centres(sample, lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.concatenate([nearest_centre(units(m), centres)[0] for _, m, _ in matrices(batch, 0, width)]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(1), batch.column(0)], names=["list", "ids", "v"])

    table = scratch.keep(distinct.select("v", "ids").mapInArrow(place, "list int, ids array<bigint>, v array<double>"))
    scratch.drop(distinct)
    return Index(width, centres, rotated_by(width), probes_for(sample, centres, k), k, table)


class Block:
    """Candidates of a block: originals, and their rotated unit vectors by column blocks."""

    def __init__(self, vectors: np.ndarray, ids: list, rotation: np.ndarray):
        self.vectors, self.ids = vectors, ids
        turned = units(vectors) @ rotation
        self.columns = [np.ascontiguousarray(turned[:, a:a + COLUMNS]) for a in range(0, turned.shape[1], COLUMNS)]

    def search(self, query: np.ndarray, turned: np.ndarray, k: int) -> list[tuple[float, int]]:
        """``cosine, row`` of up to k candidates: the best that the scan did not give up."""
        width, bound = len(turned), math.inf
        kept_rows, kept_far = np.zeros(0, np.int64), np.zeros(0)
        # The first stride is short: a bound is wanted early.
        start, stride = 0, max(4 * k, 64)
        while start < len(self.vectors):
            rows = np.arange(start, min(start + stride, len(self.vectors)))
            far = np.zeros(len(rows))
            for b, block in enumerate(self.columns):
                step = block[rows] - turned[b * COLUMNS:(b + 1) * COLUMNS]
                far = far + (step * step).sum(axis=1)
                seen = min((b + 1) * COLUMNS, width)
                if seen < width and bound < math.inf:
                    alive = far * (width / seen) <= bound * (1 + SURE / math.sqrt(seen)) ** 2
                    rows, far = rows[alive], far[alive]
                    if not len(rows):
                        break
            if len(rows):
                kept_rows, kept_far = np.concatenate([kept_rows, rows]), np.concatenate([kept_far, far])
                if len(kept_rows) > k:
                    bound = float(np.partition(kept_far, k - 1)[k - 1])
                    near = kept_far <= bound * (1 + 1e-9) + 1e-12
                    kept_rows, kept_far = kept_rows[near], kept_far[near]
            start, stride = start + stride, STRIDE
        if not len(kept_rows):
            return []
        scores = cosines(query, self.vectors[kept_rows])
        best = sorted(zip(-scores, [self.ids[r][0] for r in kept_rows], kept_rows))[:k]
        return [(-s, int(r)) for s, _, r in best]


FOUND = "query_id bigint, score double, ids array<bigint>"


def search(index: Index | None, queries: DataFrame, spark=None) -> DataFrame:
    """``query_id, rank, vec_id, score``: every query's k nearest of those found, its own id left out; ties to smaller ids.

    ``queries`` has ``vec_id, v`` as by ``valid``. A query meets the lists around its nearest centres. A list of over ``CHUNK`` candidates or ``ASKED``
    queries is split into blocks of both, so no task holds a hot list; blocks give k + 1 vectors a query, which are ranked together.
    Query ids that repeat are one query each time they hold another vector.
    """
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if index is None:
        return queries.sparkSession.createDataFrame([], empty)
    width, centres, rotation, probes, k = index.width, index.centres, index.rotation, index.probes, index.k

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, m, _ in matrices(batch, 1, width):
                near = units(m) @ centres.T
                lists = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.tile(np.arange(len(centres)), (len(m), 1))
                part = batch.slice(first, len(m))
                offsets = pa.array(np.arange(len(m) + 1) * lists.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(lists.ravel(), pa.int32()))], names=["query_id", "v", "lists"])

    asked = queries.select("vec_id", "v").distinct().mapInArrow(probed, "query_id bigint, v array<double>, lists array<int>")
    asked = asked.select("query_id", "v", F.explode("lists").alias("list"))
    sizes = index.table.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    asks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))
    # One row a list: at most LISTS.
    grid = F.broadcast(sizes.join(asks, "list").select("list", "chunks", "parts"))
    side = index.table.join(grid, "list").select(
        "list", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("query_id"), "ids", "v")
    other = asked.join(grid, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("query_id", "v"), F.col("parts")).cast("int").alias("part"),
        F.lit(1).alias("kind"), "query_id", F.lit(None).cast("array<bigint>").alias("ids"), "v")
    block = ["list", "chunk", "part"]
    met = side.unionByName(other).repartition(*block).sortWithinPartitions(*block, "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, ready = None, [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            id_lists, query_ids = batch.column(5).to_pylist(), batch.column(4).to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for first, m, _ in matrices(batch, 6, width):
                turned = units(m) @ rotation
                for i in range(len(m)):
                    *where, kind = keys[first + i]
                    if where != at:
                        at, held, ids, ready = where, [], [], None
                    if kind == 0:
                        held.append(m[i])
                        ids.append(id_lists[first + i])
                        continue
                    if ready is None:
                        if not held:
                            continue
                        ready, held = Block(np.asarray(held), ids, rotation), []
                    for score, row in ready.search(m[i], turned[i], k + 1):
                        out[0].append(query_ids[first + i])
                        out[1].append(score)
                        out[2].append(ready.ids[row])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int64()))], names=["query_id", "score", "ids"])

    found = met.mapInArrow(scan, FOUND).select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(df: DataFrame, is_query, scratch: Scratch, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """``build`` over all rows, ``search`` for those that ``is_query`` (a condition on the columns) names.

    Vectors null, without a direction, or holding null or non-finite components take no part, nor do null ids; shorter vectors
    are filled up with zeros. Rows that repeat count once. An empty table gives no rows.
    """
    return search(build(df, scratch, vec_id, vector, k), valid(df.filter(is_query), vec_id, vector))
