"""Cost-balanced packing of documents into token sequences of a fixed capacity.

A document's tokens are cut into full pieces, each a sequence of its own, and a rest. The rests of a window are assigned in
descending length to the sequence of lowest attention cost that has room for them; a rest that fits nowhere is cut to fill the
room that is left. A piece of n tokens costs ``linear * n + quadratic * n * n``: tokens attend within their piece only.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 1024
#: Rests that a task holds and packs together; at most about ``WINDOW * CAPACITY`` token numbers, 16 MB.
WINDOW = 4096


def byte_bpe_path() -> str:
    """The public byte-level vocabulary as ranks: the same numbers as ``byte_bpe_50k.json`` by tokenizers (a test compares them)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Token numbers of a text, without added tokens, by a tokenizers file or by ranks (``.tiktoken``) of a byte-level vocabulary.

    The end-of-text string in a text gives its special token either way.
    """
    if not path.endswith(".tiktoken"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return lambda text: coder.encode_to_numpy(text, allowed_special="all")


def balanced(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 512) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, first token, tokens): all of every item, no sequence over capacity, all but one full.

    Items in descending length (ties in the given order) go to the cheapest sequence with room; what fits nowhere is cut to fill
    the cheapest sequence with any room.
    """
    total = sum(lengths)
    n = -(-total // capacity)
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    if n:
        room[-1] = total - (n - 1) * capacity  # so that all others come out full
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        start, left = 0, lengths[item]
        while left:
            open_ = np.flatnonzero(room >= left)
            if not len(open_):
                open_ = np.flatnonzero(room)
            k = open_[np.argmin(cost[open_])]
            part = min(left, int(room[k]))
            out[k].append((item, start, part))
            room[k] -= part
            cost[k] += linear * part + quadratic * part * part
            start, left = start + part, left - part
    return out


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def pack(docs: DataFrame, tokenizer: Callable[[], str] | str = byte_bpe_path, capacity: int = CAPACITY, window: int = WINDOW, end_id: int = 0, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: its document, place in it, tokens, and its place in a sequence; ``ids`` holds 32-bit token numbers.

    A map-only job: a task tokenizes its rows and packs the rests of ``window`` documents at a time, so memory is bounded, nothing is
    shuffled, and of every task only the last sequence is padded. A lost task is run again as a whole; sequence numbers hold
    the partition's number in their upper bits. Null and empty texts are the end token alone. Rows that repeat are packed each;
    null ids are kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer if isinstance(tokenizer, str) else tokenizer())
        first = TaskContext.get().partitionId() << 32
        end = np.asarray([end_id], "<u4").tobytes()
        rests: list[tuple] = []
        rows: list[tuple] = []
        number = 0

        def add(doc, start, ids, total, offset):
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, first + number, offset, ids if with_ids else None))

        def flush(last: bool):
            nonlocal rests, number
            held, rests = rests, []
            sequences = balanced([len(ids) // 4 for _, _, ids, _ in held], capacity)
            for k, sequence in enumerate(sequences):
                if k == len(sequences) - 1 and not last and sum(x[2] for x in sequence) < capacity:
                    rests = [(held[i][0], held[i][1] + a, held[i][2][4 * a:4 * (a + n)], held[i][3]) for i, a, n in sequence]  # goes on into the next window
                    break
                offset = 0
                for i, a, n in sequence:
                    doc, start, ids, total = held[i]
                    add(doc, start + a, ids[4 * a:4 * (a + n)], total, offset)
                    offset += n
                number += 1

        def out():
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 7 else pa.int64()) for i, c in enumerate(columns)], names=PIECES.names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text_ in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = (encode(text_).astype("<u4", copy=False).tobytes() if text_ else b"") + end
                    total = len(ids) // 4
                    full = total // capacity * capacity
                    for a in range(0, full, capacity):
                        add(doc, a, ids[4 * a:4 * (a + capacity)], total, 0)
                        number += 1
                    if full < total:
                        rests.append((doc, full, ids[4 * full:], total))
                    if len(rests) >= window:
                        flush(False)
                if len(rows) >= 2048:
                    yield out()
        flush(True)
        if rows:
            yield out()

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)
