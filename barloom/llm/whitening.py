"""Whitening of embeddings by singular values of the centred rows.

Blockwise QR reduces the centred rows of every task to a triangle, triangles are merged into one, Householder reflections make it
bidiagonal, dqds finds its singular values to high relative accuracy, and twisted factorisations give the singular vectors. The
covariance matrix itself is never formed, so small directions keep their digits.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import Scratch

from .vectors import STEP, matrices, packed_rows, unpacked_rows, width_of

SCALE = 256
#: Tasks of the first merging step of triangles.
MERGES = 16
#: Whole numbers below this are added and multiplied as 64-bit ones, larger ones as Python's.
SAFE = 1 << 62
EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """Rows of the fit list, sums by dimension, unit components (rows) with their eigenvalues, the trace of the covariance."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trace: float = 0.0
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.sums)


def scaled(df: DataFrame, width: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``x``, the whole numbers floor(scale * c) packed into bytes.

    Left out: vectors that are null, hold null or non-finite components, or one whose scaled value is no bigint. Shorter vectors are
    filled up with zeros to ``width``. Null ids stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, c, good in matrices(batch, 1, width):
                whole = np.floor(c * scale)
                good = good & (np.abs(whole) < float(1 << 63)).all(axis=1)
                ids = batch.column(0).slice(first, len(c)).filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([ids, pa.array(packed_rows(whole[good].astype(np.int64)), pa.binary())], names=["vec_id", "x"])

    plain = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("v"))
    return plain.mapInArrow(run, "vec_id bigint, x binary")


def steps(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    rows = max(1, STEP // max(1, width))
    for first in range(0, len(column), rows):
        yield first, unpacked_rows(column.slice(first, rows).to_pylist(), width)


def sums_of(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension; every task sends one row a dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            for _, x in steps(batch.column(0), width):
                small = not len(x) or max(-int(x.min()), int(x.max())) * len(x) < SAFE
                total = [a + int(b) for a, b in zip(total, (x if small else x.astype(object)).sum(axis=0))]
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total, pa.decimal128(38, 0)), pa.array([n] * width, pa.int64())], names=["d", "total", "n"])

    rows = fit.mapInArrow(run, "d int, total decimal(38,0), n bigint").groupBy("d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("d").collect()
    return (rows[0].n, [int(r.total) for r in rows]) if rows else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit numbers, or Python's where those might not hold them."""
    most = max(-int(x.min()), int(x.max())) if x.size else 0
    if n * most + max(map(abs, sums), default=0) < SAFE:
        return x * n - np.asarray(sums, np.int64)
    return x.astype(object) * n - np.asarray(sums, object)


def triangle(blocks: Iterator[np.ndarray], width: int) -> np.ndarray | None:
    """The triangle of the QR factorisation of all rows, one block at a time."""
    r = None
    for block in blocks:
        r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    return r


def reduced(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """One triangle whose Gram matrix is that of all centred rows. Every task gives one; these are merged in two steps."""
    width = len(sums)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle((deviations(x, n, sums).astype(float) / n for batch in batches for _, x in steps(batch.column(0), width)), width)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["r"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle((np.frombuffer(v.as_py()).reshape(-1, width) for batch in batches for v in batch.column(0)), width)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["r"])

    merged = fit.mapInArrow(first, "r binary").repartition(MERGES).mapInArrow(merge, "r binary").repartition(1).mapInArrow(merge, "r binary")
    r = np.frombuffer(bytes(merged.first()[0])).reshape(-1, width)
    return np.vstack([r, np.zeros((width - len(r), width))])


def reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector whose reflection turns ``x`` into a multiple of the first axis."""
    largest = np.abs(x).max() if len(x) else 0.0
    if not largest or not np.abs(x[1:]).any():
        return None
    v = x / largest
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, upper diagonal and right reflectors of an upper bidiagonal matrix with the singular values of ``r``."""
    m, right = r.copy(), []
    d = len(m)
    for k in range(d):
        v = reflector(m[k:, k].copy())
        if v is not None:
            m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        v = reflector(m[k, k + 1:].copy()) if k + 2 < d else None
        if v is not None:
            m[k:, k + 1:] -= 2 * np.outer(m[k:, k + 1:] @ v, v)
        right.append(v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by dqds.

    The shift tried first is the smaller eigenvalue of the last two rows; where it is too large, Newton's bound, which never is.
    """
    unit = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if not unit:
        return np.zeros(len(a))
    q = [max(float(v), 1e-200) for v in (a / unit) ** 2]
    e = [float(v) if v > 1e-280 else 0.0 for v in (b / unit) ** 2]
    done, shift, rounds = [], 0.0, 0

    def sweep(s: float):
        new_q, new_e, least, inverse = [], [], float("inf"), 0.0
        d = q[0] - s
        for i in range(len(q)):
            if not d >= 0 or (d == 0 and s):
                return None
            d = max(d, 1e-290)
            least, inverse = min(least, d), inverse + 1 / d
            if i == len(q) - 1:
                new_q.append(d)
                break
            new_q.append(d + e[i])
            t = q[i + 1] / new_q[-1]
            new_e.append(e[i] * t)
            d = d * t - s
        return new_q, new_e, least, inverse

    while q:
        while len(q) > 1 and e[-1] > (100 * EPS) ** 2 * (shift + q[-1]):
            rounds += 1
            if rounds > 2000 * len(a):
                raise ArithmeticError("dqds does not converge")
            plain = sweep(0.0)
            # The smaller eigenvalue of the last two rows of the squared matrix.
            x, y, z = q[-2] + e[-1], q[-1], q[-1] * e[-1]
            half = (x - y) / 2
            guess = y - z / (half + np.copysign(np.sqrt(half * half + z), half)) if half or z else y
            guess = min(float(guess), plain[2]) * (1 - 4 * EPS)
            best = sweep(guess) if guess > 0 else None
            if best is None:
                guess = (1 - 1e-10) / plain[3]
                best = sweep(guess) if guess > EPS * (shift + q[-1]) else None
            if best is None:
                guess, best = 0.0, plain
            q, e, shift = best[0], best[1], shift + guess
        done.append(shift + q.pop())
        if q:
            e.pop()
    return np.sort(np.asarray(done))[::-1] * unit * unit


def twisted_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors (rows) of a bidiagonal matrix for the largest of ``values``.

    For every value the stationary factorisation from the top and the progressive one from the bottom meet at the row where their
    twisted diagonal is smallest; vectors of values that nearly agree are made orthogonal, further meeting rows are tried where one gives
    nothing new.
    """
    n, unit = len(a), max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if not unit:
        return np.eye(n)[:len(values)]
    tiny = EPS * EPS
    a = np.where(np.abs(a) < tiny * unit, tiny * unit, a) / unit
    b = b / unit
    diagonal, low = a * a, b / a[:-1]
    found: list[np.ndarray] = []
    for j, value in enumerate(values / unit / unit):
        s, p = np.empty(n), np.empty(n)
        upper, lower = np.empty(max(0, n - 1)), np.empty(max(0, n - 1))
        s[0] = -value
        for i in range(n - 1):
            top = (s[i] + diagonal[i]) or tiny * tiny
            upper[i] = diagonal[i] * low[i] / top
            s[i + 1] = upper[i] * low[i] * s[i] - value
        p[-1] = diagonal[-1] - value
        for i in range(n - 2, -1, -1):
            bottom = (diagonal[i] * low[i] ** 2 + p[i + 1]) or tiny * tiny
            t = diagonal[i] / bottom
            lower[i] = low[i] * t
            p[i] = p[i + 1] * t - value
        gamma = np.abs(s + p + value)
        close = [found[i] for i in range(j) if abs(values[i] - values[j]) <= 1e-3 * values[0]]
        best, kept = None, -1.0
        for r in np.argsort(gamma, kind="stable"):
            z = np.zeros(n)
            z[r] = 1.0
            for i in range(r - 1, -1, -1):
                z[i] = -upper[i] * z[i + 1]
            for i in range(r, n - 1):
                z[i + 1] = -lower[i] * z[i]
            with np.errstate(over="ignore", invalid="ignore"):
                z = z / np.abs(z).max()
                z = z / np.linalg.norm(z)
            if not np.isfinite(z).all():
                continue
            for _ in range(2):
                for other in close:
                    z = z - other * (other @ z)
            left = float(np.linalg.norm(z))
            if left > kept:
                best, kept = z / max(left, 1e-300), left
            if left > 0.5:
                break
        found.append(best if best is not None else np.eye(n)[j])
    return np.asarray(found)


def fit(rows: DataFrame, width: int, scratch: Scratch, k: int = 4) -> Whitening:
    """The whitening of the table of ``scaled``, every distinct vector counted once.

    Distinct vectors are found by a map-side combined aggregate over packed bytes and written once; three passes over them add up
    the sums, reduce the centred rows, and measure the covariance of the whitened rows. The driver sees sums and one triangle, both bounded
    by the width. An empty table gives an empty model; where all rows are equal, every eigenvalue is 0.
    """
    if not width:
        return Whitening()
    distinct = scratch.keep(rows.select("x").distinct())
    n, sums = sums_of(distinct, width)
    if not n:
        return Whitening()
    a, b, right = bidiagonal(reduced(distinct, n, sums))
    squares = squared_singular_values(a, b)
    z = twisted_vectors(a, b, squares[:k])
    for i in range(len(right) - 1, -1, -1):
        if right[i] is not None:
            z[:, i + 1:] -= 2 * np.outer(z[:, i + 1:] @ right[i], right[i])
    eigenvalues = np.where(squares > squares[0] * (EPS * max(n ** 0.5, width)) ** 2, squares, 0) / n
    model = Whitening(n, sums, z, eigenvalues[:k], float(eigenvalues.sum()))
    known = [i for i in range(len(model.eigenvalues)) if model.eigenvalues[i] > 0]
    if known:
        wide = project(distinct, model)
        pairs = [(i, j) for i in known for j in known if i <= j]
        moments = wide.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
        model.identity_error = max(abs(m - (i == j)) for m, (i, j) in zip(moments, pairs))
    return model


def whitened_rows(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Exact n * x - S, and (x - S / n) projected on the components over the roots of their eigenvalues."""
    exact = deviations(x, model.n, model.sums)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = (exact.astype(float) / model.n) @ model.components.T / np.sqrt(model.eigenvalues)
    return exact, w


def project(fit_list: DataFrame, model: Whitening) -> DataFrame:
    """``w``: the whitened components of every row, in an array."""
    def run(batches):
        for batch in batches:
            for _, x in steps(batch.column(0), model.width):
                w = whitened_rows(x, model)[1]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([flat], names=["w"])

    return fit_list.select("x").mapInArrow(run, "w array<double>")


RESULT = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
    T.StructField("identity_error", T.DoubleType()),
])


def squared(exact: np.ndarray) -> list:
    """Sums of squares by row; null where one has over 38 digits."""
    most = max(-int(exact.min()), int(exact.max())) if exact.size else 0
    if most * most * max(1, exact.shape[1]) < SAFE:
        return (exact * exact).sum(axis=1).tolist()
    wide = exact.astype(object)
    return [int(v) if v < 10 ** 38 else None for v in (wide * wide).sum(axis=1)]


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row for every row of ``scaled`` and component, in one pass without a shuffle.

    ``deviation`` is exact, null only beyond 38 digits. Components of eigenvalue 0 (a table with fewer directions than components) have a null
    ``whitened`` and ``explained`` 0. Rows that repeat are given each.
    """
    known = model.eigenvalues > 0
    explained = [float(v) / model.trace if v > 0 else 0.0 for v in model.eigenvalues]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.eigenvalues)
        for batch in batches:
            for first, x in steps(batch.column(1), model.width):
                if not k:
                    continue
                exact, w = whitened_rows(x, model)
                m = len(x)
                w[:, ~known] = 0
                each = np.repeat(np.arange(m), k)
                columns = [
                    batch.column(0).slice(first, m).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)), pa.array(squared(exact), pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(w.ravel(), mask=np.tile(~known, m)), pa.array(np.tile(explained, m), pa.float64()),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=RESULT.names)

    return rows.mapInArrow(run, RESULT)


def whiten(df: DataFrame, scratch: Scratch, vec_id: str = "vec_id", vector: str = "embedding", k: int = 4, scale: int = SCALE) -> DataFrame:
    """``scaled``, ``fit`` and ``whitened`` in turn."""
    width = width_of(df, vector)
    rows = scaled(df, width, vec_id, vector, scale)
    return whitened(rows, fit(rows, width, scratch, k))
