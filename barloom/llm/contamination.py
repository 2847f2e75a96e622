"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item (an item of fewer words is one window of its own
length). Patterns of one length are searched together: a shift table over blocks of two words says how far the search may jump,
blocks with shift 0 lead to a bucket of patterns by their last block, whose words are then compared one by one.
"""
from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, byte_words, bytes_of

#: Bytes of benchmark text that one pass searches for. Larger benchmarks are searched in several passes, none is cut.
BLOCK_BYTES = 32 << 20


class WindowSearch:
    """Wu-Manber tables for all windows of one length; words are numbers from 1, 0 stands for any other word."""

    def __init__(self, patterns: dict[tuple[int, ...], int], length: int, words: int):
        self.length, self.base = length, words + 1
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
        for pattern, number in patterns.items():
            for end in range(self.block, length + 1):
                key = self.key(pattern[end - self.block:end])
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets[self.key(pattern[length - self.block:])].append((pattern, number))
        self.buckets = dict(self.buckets)

    def key(self, block) -> int:
        return block[0] * self.base + block[1] if self.block == 2 else block[0]

    def find(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        m, n, far, base, shift = self.length, len(ids), self.far, self.base, self.shift
        two, at = self.block == 2, self.length - 1
        while at < n:
            key = ids[at - 1] * base + ids[at] if two else ids[at]
            jump = shift.get(key, far)
            if jump:
                at += jump
                continue
            start = at - m + 1
            first = ids[start]
            for pattern, number in self.buckets[key]:
                if pattern[0] == first and all(ids[start + i] == w for i, w in enumerate(pattern)):
                    yield start, number
            at += 1


class Searches:
    """All windows of a block of items."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        by_length: dict[int, dict[tuple[int, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [number(w, len(self.vocabulary) + 1) for w in byte_words(text)]
            m = min(window, len(ids))
            for i in range(len(ids) - m + 1 if m else 0):
                by_length[m][tuple(ids[i:i + m])].add(item)
        self.owners: list[tuple] = []
        self.searches = []
        for m, windows in sorted(by_length.items()):
            patterns = {}
            for pattern, owners in windows.items():
                patterns[pattern] = len(self.owners)
                self.owners.append(tuple(owners))
            self.searches.append(WindowSearch(patterns, m, len(self.vocabulary)))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of words (end excluded) inside occurrences, and the items that occur."""
        get = self.vocabulary.get
        ids = [get(w, 0) for w in words]
        spans, found = [], set()
        for search in self.searches:
            for start, number in search.find(ids):
                spans.append((start, start + search.length))
                found.update(self.owners[number])
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (of hit words, array of start and end) and ``leaked_items`` (sorted array of text).

    Map-only over ``docs``. Items are taken in blocks of about ``block_bytes``; a block is all that the driver and a task ever
    hold of the benchmark. Null texts have no words, items without words no windows; an item without id is named ``null``; rows with
    the same id count as one item. Empty tables give no hits. New columns that clash with names of ``docs`` get underscores.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    blocks = max(1, math.ceil(bytes_of(items, "t") / block_bytes))
    fields = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("leaked_items", T.ArrayType(T.StringType()))])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out, added = docs, []
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        tables = spark.sparkContext.broadcast(Searches([(r.i, r.t.encode()) for r in block.collect()], window))

        def scan(batches, tables=tables):
            for texts in batches:
                counts, spans, found = [], [], []
                for t in texts:
                    words = byte_words(t)
                    s, f = tables.value.scan(words)
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    found.append(sorted(f))
                yield [pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array(found, pa.list_(pa.string()))]

        before = len(out.columns)
        out = annotate(out, text, fields, scan)
        added.append(out.columns[before:])
    if blocks == 1:
        return out
    counts, spans, found = zip(*added)
    kept = [c for c in out.columns if c in docs.columns]
    every = F.array_sort(F.flatten(F.array(*[F.col(f"`{c}`") for c in spans])))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{counts[0]}`"), join_spans(every).alias(spans[0]), F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"`{c}`") for c in found])))).alias(found[0]))


def join_spans(spans):
    """Overlapping and touching spans of a sorted array become one."""
    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        touches = (F.size(done) > 0) & (x["start"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"), step)


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items that occur and their digest."""
    found = find_leaks(docs.select("doc_id", "text"), items)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("leaked_items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("leaked_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def digest_of(items: list[str]) -> str:
    """The digest that ``leak_report`` gives to these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def drop_leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no window of an item occurs, with their own columns."""
    found = find_leaks(docs, items)
    spans = found.columns[len(docs.columns) + 1]
    return found.filter(F.size(f"`{spans}`") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
