"""Vectors of Arrow batches as matrices, and their packing into bytes."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components that a step holds as doubles.
STEP = 1 << 21


def usable(vector: str) -> F.Column:
    """True for vectors that are neither null nor hold null or non-finite components."""
    return F.coalesce(F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def width_of(df: DataFrame, vector: str) -> int:
    """Components of the longest usable vector; 0 where there is none."""
    return df.agg(F.max(F.when(usable(vector), F.size(vector)))).first()[0] or 0


def matrices(batch: pa.RecordBatch, at: int, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, doubles, usable`` of a batch's list column in steps of a bounded size.

    Shorter vectors are filled up with zeros; null vectors and those that hold null or non-finite components are not usable.
    """
    rows = max(1, STEP // max(1, width))
    for first in range(0, batch.num_rows, rows):
        column = batch.column(at).slice(first, rows)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(valid, np.diff(column.offsets.to_numpy()), 0)
        flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        good = np.isfinite(flat)
        bad = np.concatenate([[0], np.cumsum(~good)])
        valid = valid & (bad[ends] == bad[ends - lengths])
        out = np.zeros((len(lengths), width))
        if width and len(lengths) and (lengths == width).all():
            out[:] = flat.reshape(-1, width)
        elif width:
            fits = np.minimum(lengths, width)
            out[np.arange(width) < fits[:, None]] = flat[np.arange(len(flat)) - np.repeat(ends - lengths, lengths) < width]
        out[~valid] = 0
        yield first, out, valid


def packed_rows(x: np.ndarray) -> list[bytes]:
    """Every row of whole numbers in the narrowest of 1, 2, 4 or 8 bytes a number: equal rows give equal bytes."""
    out: list[bytes] = [b""] * len(x)
    low, high = (x.min(axis=1), x.max(axis=1)) if x.shape[1] and len(x) else (np.zeros(len(x)), np.zeros(len(x)))
    left = np.ones(len(x), bool)
    for size in (1, 2, 4, 8):
        limit = np.iinfo(f"i{size}")
        rows = np.flatnonzero(left & (low >= limit.min) & (high <= limit.max))
        left[rows] = False
        data, step = x[rows].astype(f"<i{size}").tobytes(), size * x.shape[1]
        for k, row in enumerate(rows):
            out[row] = data[k * step:(k + 1) * step]
    return out


def unpacked_rows(rows: list[bytes], width: int) -> np.ndarray:
    """The matrix of ``packed_rows``."""
    out = np.zeros((len(rows), width), np.int64)
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    for size in (1, 2, 4, 8):
        at = np.flatnonzero(sizes == size * width) if width else ()
        if len(at):
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), f"<i{size}").reshape(len(at), width)
    return out
