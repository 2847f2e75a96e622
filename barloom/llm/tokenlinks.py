"""Alignment of two tokenizers over a corpus, counted by external spill.

Both tokenizers' tokens are cut into groups where their byte ends agree; tokens of a group are linked. A task collects pair-document
records up to a bound, sorts them with the first tokenizer's id as the major key, and writes them as a zstd run: one count list per
radix partition of the major id, and one list of the documents in the same order. Count lists are merged by a heap over the runs'
chunks into the documents of every pair; as all pairs of a major id stand together there, its highest count is known at its end. The totals
then stream back through the runs' own lists, and every run adds up its documents.
"""
from __future__ import annotations

import functools
import hashlib
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import Scratch

#: Pair-document records of a run; radix partitions of the major id; runs that one merge opens; pairs of a chunk.
RUN, PARTS, FAN, CHUNK = 1 << 21, 64, 128, 1 << 14
#: Links of a group from which equal ids are counted before they are paired.
WIDE = 4096
LEVEL = 3


def default_paths() -> tuple[str, str]:
    """The public byte-level and piece vocabularies. The first is read as ranks: the same numbers as ``byte_bpe_50k.json`` (a test compares them)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers, with the bytes of their entries."""

    def __init__(self, byte_ranks: str, pieces: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(byte_ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            self.a_bytes[i] = data
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_size, self.b_size = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        # Ids as text with what may follow them: another id of the side, the other side, the next group.
        self.a_text = np.array([f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"], object)
        self.b_text = np.array([f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"], object)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None where a text has none or the bytes of either do not give the text back."""
        if not text:
            return None
        whole = (" " + text).encode()
        a = self.a.encode_ordinary(" " + text)
        if b"".join([self.a_bytes[i] for i in a]) != whole:
            return None
        b = self.b.encode(text, num_threads=1) if len(text) < 1 << 20 else self.b.encode(text)
        if b"".join([self.b_bytes[i] for i in b]) != whole:
            return None
        return np.asarray(a, np.int64), np.asarray(b, np.int64)


@functools.lru_cache(maxsize=2)
def opened(byte_ranks: str, pieces: str) -> Pair:
    return Pair(byte_ranks, pieces)


def links_of(pair: Pair, a: np.ndarray, b: np.ndarray) -> tuple[int, int, str, np.ndarray, np.ndarray]:
    """Groups, links, the groups as text, and the distinct id pairs (major id in the upper half) with their links."""
    a_ends, b_ends = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
    n = len(cuts)
    a_count, b_count = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    a_stop, b_stop = np.cumsum(a_count), np.cumsum(b_count)
    a_last = np.zeros(len(a), np.int64)
    a_last[a_stop - 1] = 1
    b_last = np.zeros(len(b), np.int64)
    b_last[b_stop - 1] = 1
    words = np.empty(len(a) + len(b), object)
    words[np.arange(len(a)) + (b_stop - b_count)[a_group]] = pair.a_text[2 * a + a_last]
    words[np.arange(len(b)) + a_stop[b_group]] = pair.b_text[2 * b + b_last]
    text = "".join(words.tolist())[:-1]

    each = a_count * b_count
    small = each < WIDE
    times = np.where(small[a_group], b_count[a_group], 0)
    stop = np.cumsum(times)
    inner = np.arange(stop[-1]) - np.repeat(stop - times, times) if len(stop) else np.zeros(0, np.int64)
    keys = (np.repeat(a, times) << 32) | b[np.repeat((b_stop - b_count)[a_group], times) + inner]
    codes, counts = np.unique(keys, return_counts=True)
    if not small.all():
        more_codes, more_counts = [codes], [counts]
        for g in np.flatnonzero(~small):
            left, m = np.unique(a[a_stop[g] - a_count[g]:a_stop[g]], return_counts=True)
            right, k = np.unique(b[b_stop[g] - b_count[g]:b_stop[g]], return_counts=True)
            more_codes.append(((left[:, None] << 32) | right).ravel())
            more_counts.append((m[:, None] * k).ravel())
        codes, at = np.unique(np.concatenate(more_codes), return_inverse=True)
        counts = np.bincount(at, np.concatenate(more_counts)).astype(np.int64)
    return n, int(each.sum()), text, codes, counts


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as one zstd frame, each in the narrowest width that holds it."""
    parts = []
    for c in columns:
        kind = next(t for t in ("u1", "u2", "u4", "u8") if not len(c) or int(c.max()) <= np.iinfo(t).max)
        data = c.astype("<" + kind).tobytes()
        parts += [kind.encode(), len(c).to_bytes(8, "little"), data]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def opened_columns(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = raw[at:at + 2].decode(), int.from_bytes(raw[at + 2:at + 10], "little")
        size = n * int(kind[1])
        out.append(np.frombuffer(raw, "<" + kind, n, at + 10).astype(np.int64))
        at += 10 + size
    return out


def steps_of(codes: np.ndarray) -> np.ndarray:
    """Rising numbers as differences, which compress well."""
    return np.diff(codes, prepend=0)


ENTRY = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
RUNS = f"kind int, run bigint, part int, data array<binary>, docs array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ENTRY.split(', '))}>>"


def spilled(docs: DataFrame, paths: Callable[[], tuple[str, str]], doc_id: str, text: str, run_records: int) -> DataFrame:
    """Runs of all documents: kind 0 holds a run's documents and their records, kind 1 its count list in one partition.

    A run ends after the document that fills it, so a document lies in one run. A task holds one run.
    """
    entry = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])
    names = ["kind", "run", "part", "data", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = opened(*paths())
        first, number, held = TaskContext.get().partitionId() << 32, 0, 0
        entries: list[tuple] = []
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, number
            this = first + number
            code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            links = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
            part = (code >> 32) % PARTS
            order = np.lexsort((code, part))  # stable: a pair's documents stay in order
            code, links, owner, part = code[order], links[order], owner[order], part[order]
            new = np.flatnonzero(np.diff(code, prepend=-1))
            seen = np.diff(new, append=len(code))
            pieces = [(0, this, None, [squeezed(seen), squeezed(owner), squeezed(links)], entries)]
            bounds = np.searchsorted(part[new], np.arange(PARTS + 1))
            for p in range(PARTS):
                a, b = bounds[p], bounds[p + 1]
                if a < b:
                    pieces.append((1, this, p, chunks(code[new[a:b]], seen[a:b]), None))
            for piece in pieces:
                yield pa.RecordBatch.from_arrays([
                    pa.array([piece[0]], pa.int32()), pa.array([piece[1]], pa.int64()), pa.array([piece[2]], pa.int32()), pa.array([piece[3]], pa.list_(pa.binary())),
                    pa.array([None if piece[4] is None else [dict(zip(ENTRY_NAMES, e)) for e in piece[4]]], pa.list_(entry)),
                ], names=names)
            held, number = 0, number + 1
            for store in (entries, codes, counts, owners):
                store.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                for doc, content in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    ids = pair.tokens(content)
                    if ids is None:
                        entries.append((doc, 0, 0, 0, 0, ""))
                    else:
                        groups, links, shown, code, times = links_of(pair, *ids)
                        owners.append(np.full(len(code), len(entries)))
                        codes.append(code)
                        counts.append(times)
                        held += len(code)
                        entries.append((doc, len(ids[0]), len(ids[1]), groups, links, hashlib.sha256(shown.encode()).hexdigest()))
                    if held >= run_records or len(entries) >= run_records // 16:
                        yield from flush()
        if entries:
            yield from flush()

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, RUNS)


ENTRY_NAMES = [f.split()[0] for f in ENTRY.split(", ")]


def chunks(codes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    return [squeezed(steps_of(codes[i:i + CHUNK]), counts[i:i + CHUNK]) for i in range(0, len(codes), CHUNK)]


def merged(lists: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in order with the sums of their counts, by a heap over the lists' open chunks.

    The heap holds the last pair of every open chunk. What stands up to the smallest of these is complete: it is taken from all
    open chunks, added up and given out, and the list whose chunk is used up opens its next one.
    """
    open_: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []
    at = [0] * len(lists)

    def load(i: int) -> None:
        if at[i] < len(lists[i]):
            gaps, counts = opened_columns(lists[i][at[i]])
            at[i] += 1
            open_[i] = [np.cumsum(gaps), counts]
            heapq.heappush(heap, (int(open_[i][0][-1]), i))

    for i in range(len(lists)):
        load(i)
    while heap:
        last = heap[0][0]
        codes, counts = [], []
        for i, (c, k) in open_.items():
            n = int(np.searchsorted(c, last, side="right"))
            if n:
                codes.append(c[:n])
                counts.append(k[:n])
                open_[i] = [c[n:], k[n:]]
        while heap and heap[0][0] == last:
            load(heapq.heappop(heap)[1])
        found, where = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, where, np.concatenate(counts))
        yield found, total


def merge_lists(lists: DataFrame) -> DataFrame:
    """``part, grp, data`` lists of a partition and group as one list each, in new chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, group), members in by_key(batches, 2):
            data: list[bytes] = []
            codes, counts, n = [], [], 0
            for c, k in merged([m[0] for m in members]):
                codes.append(c)
                counts.append(k)
                n += len(c)
                if n >= CHUNK:
                    c, k = np.concatenate(codes), np.concatenate(counts)
                    whole = n // CHUNK * CHUNK
                    data += chunks(c[:whole], k[:whole])
                    codes, counts, n = [c[whole:]], [k[whole:]], n - whole
            if n:
                data += chunks(np.concatenate(codes), np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([group], pa.int64()), pa.array([data], pa.list_(pa.binary()))], names=["part", "grp", "data"])

    return lists.select("part", "grp", "data").repartition("part", "grp").sortWithinPartitions("part", "grp").mapInArrow(run, "part int, grp bigint, data array<binary>")


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Sorted rows by their first columns: a key and the other columns of its rows."""
    key, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(batch.column(c)[i].as_py() for c in range(batch.num_columns))
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def totals(lists: DataFrame, runs: int, fan: int) -> DataFrame:
    """One list per partition: ``part, data`` with every pair's documents over the whole corpus; merges open ``fan`` lists at a time."""
    now = lists.select("part", F.col("run").alias("grp"), "data")
    while runs > max(fan, 1):
        runs = min(math.ceil(2 * runs / fan), (runs + 1) // 2)  # groups are dealt by hash: half of the fan on average
        now = merge_lists(now.withColumn("grp", F.pmod(F.xxhash64("grp"), F.lit(runs))))
    return merge_lists(now.withColumn("grp", F.lit(0).cast("bigint"))).select("part", "data")


def answered(lists: DataFrame, total: DataFrame, spread: int) -> DataFrame:
    """``run, part, data``: for every pair of a run's list its corpus-wide count, and whether that is its major id's highest.

    A partition's totals go to ``spread`` tasks, its lists are dealt over these. Lists stream by; a task holds one partition's totals, at most
    the pairs that the vocabularies allow there.
    """
    salt = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    side = total.select("part", salt.alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("run"), "data")
    other = lists.select("part", F.pmod(F.xxhash64("run"), F.lit(spread)).cast("int").alias("salt"), F.lit(1).alias("kind"), "run", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = counts = best = None
        for batch in batches:
            for i in range(batch.num_rows):
                data = [opened_columns(x.as_py()) for x in batch.column(4)[i]]
                code = np.concatenate([np.cumsum(x[0]) for x in data])
                if batch.column(2)[i].as_py() == 0:
                    codes, counts = code, np.concatenate([x[1] for x in data])
                    starts = np.flatnonzero(np.diff(codes >> 32, prepend=-1))
                    highest = np.maximum.reduceat(counts, starts)
                    best = counts == np.repeat(highest, np.diff(starts, append=len(codes)))
                    continue
                at = np.searchsorted(codes, code)
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(i, 1), batch.column(0).slice(i, 1), pa.array([squeezed(counts[at], best[at].astype(np.int64))], pa.binary())], names=["run", "part", "data"])

    return side.unionByName(other).repartition("part", "salt").sortWithinPartitions("part", "salt", "kind").mapInArrow(run, "run bigint, part int, data binary")


RESULT = f"{ENTRY}, n_best bigint, count_sum bigint"


def summed(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Every document's result: a run's records meet the answers for its pairs, in the order they were written."""
    side = answers.select("run", "part", F.array("data").alias("data"), F.lit(None).cast(records.schema["docs"].dataType).alias("docs"))
    other = records.select("run", F.lit(PARTS).alias("part"), "data", "docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[np.ndarray] = []
        best: list[np.ndarray] = []
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py()
                if batch.column(1)[i].as_py() < PARTS:
                    c, b = opened_columns(data[0])
                    counts.append(c)
                    best.append(b)
                    continue
                docs = batch.column(3).slice(i, 1).flatten()
                (seen,), (owner,), (links,) = map(opened_columns, data)
                each = [np.repeat(np.concatenate(x) if x else np.zeros(0, np.int64), seen) * links for x in (best, counts)]
                sums = []
                for weights in each:
                    total = np.zeros(len(docs), np.int64)
                    np.add.at(total, owner, weights)
                    sums.append(pa.array(total))
                counts, best = [], []
                yield pa.RecordBatch.from_arrays([*docs.flatten(), *sums], names=[*ENTRY_NAMES, "n_best", "count_sum"])

    return side.unionByName(other).repartition("run").sortWithinPartitions("run", "part").mapInArrow(run, RESULT)


def align(docs: DataFrame, scratch: Scratch, paths: Callable[[], tuple[str, str]] = default_paths, doc_id: str = "doc_id", text: str = "text", run_records: int = RUN, fan: int = FAN) -> DataFrame:
    """One row per document: its tokens by both tokenizers, groups, links, and what the corpus-wide pair counts say about these links.

    ``n_best`` counts links whose pair is found in as many documents as any pair of its first id; ``count_sum`` adds up the documents of
    every link's pair. A document counts once for a pair. Null and empty texts, and those that a tokenizer does not give back byte for
    byte, have no tokens: zeros and an empty text. Rows that repeat are documents each; null ids are kept. An empty table gives no rows.

    Hot ids cost nothing extra: a run holds one count per pair, so a partition receives at most a run's distinct pairs from each. No
    pair count is sent to all tasks.
    """
    runs = scratch.keep(spilled(docs, paths, doc_id, text, run_records))
    records, lists = runs.filter("kind = 0"), runs.filter("kind = 1").select("run", "part", "data")
    number = records.count()
    total = scratch.keep(totals(lists, number, fan))
    return summed(records, answered(lists, total, max(1, math.ceil(number / fan))))


def pair_counts(docs: DataFrame, scratch: Scratch, paths: Callable[[], tuple[str, str]] = default_paths, doc_id: str = "doc_id", text: str = "text", run_records: int = RUN, fan: int = FAN) -> DataFrame:
    """``a_id, b_id, documents`` of every pair that is linked somewhere: a translation table from one vocabulary to the other."""
    lists = scratch.keep(spilled(docs, paths, doc_id, text, run_records))
    total = totals(lists.filter("kind = 1"), lists.filter("kind = 0").count(), fan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                for x in row:
                    gaps, counts = opened_columns(x.as_py())
                    codes = np.cumsum(gaps)
                    yield pa.RecordBatch.from_arrays([pa.array(codes >> 32), pa.array(codes & 0xFFFFFFFF), pa.array(counts)], names=["a_id", "b_id", "documents"])

    return total.select("data").mapInArrow(run, "a_id bigint, b_id bigint, documents bigint")
