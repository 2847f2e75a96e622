"""Helpers shared by the text operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Maps A-Z to a-z, every byte that is no word byte to a space. Word bytes: digits, letters and all of UTF-8 beyond ASCII.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def byte_words(data: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text as bytes, ASCII letters in lower case. Null has none."""
    return data.translate(WORD_BYTES).split() if data else []


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def annotate(df: DataFrame, column: str, fields: T.StructType, fn: Callable[[Iterator[list[bytes | None]]], Iterator[list[pa.Array]]]) -> DataFrame:
    """``df`` with the columns that ``fn`` computes from the text in ``column``, in one pass and without a shuffle.

    ``fn`` gets an iterator over the batches of a partition, each a list of UTF-8 texts, and yields the new columns of each.
    New columns are added under a free name, see ``free_name``.
    """
    names, added = list(df.columns), []
    for f in fields:
        added.append(T.StructField(free_name(df, f.name), f.dataType))
    at = next(i for i, c in enumerate(names) if c.lower() == column.lower())
    out = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts():
            for batch in batches:
                held.append(batch)
                yield as_bytes(batch.column(at))

        for new in fn(texts()):
            batch = held.pop(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[str(i) for i in range(len(out))])

    plain = df.toDF(*[str(i) for i in range(len(names))])  # positions as names: any name in the table will do
    schema = T.StructType([T.StructField(str(i), f.dataType) for i, f in enumerate(out)])
    return plain.mapInArrow(run, schema).toDF(*[f.name for f in out])


def row_hash(*columns) -> F.Column:
    """A 64-bit hash of the columns, null where all are."""
    return F.xxhash64(*columns)


def bytes_of(df: DataFrame, column: str) -> int:
    """UTF-8 bytes in a text column of the whole table."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
