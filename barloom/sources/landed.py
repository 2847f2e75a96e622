"""Landed files: manifests with hashes and row counts, symbol-months, reference snapshots, nested facts."""
from __future__ import annotations

import hashlib
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a task holds of a file while it hashes it.
CHUNK = 8 << 20
SNAPSHOT = "pit_date string, state string, raw_sha256 string, rows array<struct<ticker: string, name: string, type: string, market: string, primary_exchange: string, list_date: string>>"
FACTS = "key bigint, facts map<string, struct<label: string, units: map<string, array<struct<end: string, val: double, form: string, filed: string>>>>>"


def folder_path(spark: SparkSession, root: str) -> str:
    """The path of a folder without its scheme and host, as file columns of its files begin."""
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")


def relative(column: str, folder: str, escaped: bool = True) -> F.Column:
    """A file's path below ``folder``; ``_metadata.file_path`` is an escaped address, the path of a binary file is not."""
    plain = F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))) if escaped else F.col(column)
    return F.substring_index(plain, folder + "/", -1)


def present_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``relative_path, bytes`` of every file below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(relative("path", folder_path(spark, root), escaped=False).alias("relative_path"), F.col("length").alias("bytes"))


def opened_store(root: str):
    """The file system of a folder and the folder's path there; a path without a scheme is local (or mounted)."""
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), urllib.parse.unquote(urllib.parse.urlparse(root).path)
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def hashed_files(files: DataFrame, root: str) -> DataFrame:
    """``files`` (``relative_path``) with ``sha256`` of each, null where it cannot be opened.

    Tasks read the shared folder in chunks, so a file of any size takes ``CHUNK`` bytes of memory. Paths that leave the folder are not opened.
    """
    names = [f.name for f in files.schema]
    at = names.index("relative_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened_store(root)
        for batch in batches:
            found = []
            for name in batch.column(at).to_pylist():
                digest = None
                if name and not name.startswith("/") and ".." not in name.split("/"):
                    try:
                        with store.open_input_stream(f"{base.rstrip('/')}/{name}", buffer_size=None) as stream:
                            digest = hashlib.sha256()
                            while block := stream.read(CHUNK):
                                digest.update(block)
                    except FileNotFoundError:
                        digest = None
                found.append(digest.hexdigest() if digest else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*names, "sha256"])

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}, sha256 string"
    return files.repartition("relative_path").mapInArrow(run, schema)


def manifest_verdicts(spark: SparkSession, root: str, manifest: DataFrame, pattern: str = "*", counted: DataFrame | None = None) -> DataFrame:
    """Every listed or present file with its verdict; ``manifest`` has relative_path, sha256 and, with ``counted``, rows.

    ``counted`` (relative_path, rows_read) comes from reading the files. In this order: path_escape, missing_file, unlisted_file, hash_mismatch,
    row_mismatch, ok. A file whose name leaves the folder is never opened.
    """
    escape = F.col("relative_path").startswith("/") | F.array_contains(F.split("relative_path", "/"), "..")
    listed = manifest.select("relative_path", F.col("sha256").alias("expected_sha256"), *([F.col("rows").alias("expected_rows")] if "rows" in manifest.columns else []))
    there = present_files(spark, root, pattern)
    hashed = hashed_files(there.join(listed.select("relative_path"), "relative_path", "left_semi"), root).select("relative_path", "sha256")
    out = listed.join(there, "relative_path", "full").join(hashed, "relative_path", "left")
    rows = F.lit(False)
    if counted is not None:
        out = out.join(counted, "relative_path", "left")
        rows = ~F.coalesce("rows_read", F.lit(0)).eqNullSafe(F.col("expected_rows"))
    verdict = (
        F.when(escape, "path_escape").when(F.col("bytes").isNull(), "missing_file").when(F.col("expected_sha256").isNull(), "unlisted_file")
        .when(~F.col("sha256").eqNullSafe(F.col("expected_sha256")), "hash_mismatch").when(rows, "row_mismatch").otherwise("ok")
    )
    return out.withColumn("verdict", verdict)


def read_manifest_bars(spark: SparkSession, root: str, manifest: DataFrame, schema: str, pattern: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """CSV bars of the files that a manifest vouches for, and the verdict of every file.

    One read serves counts and bars: rows carry their file's path, which meets the manifest by equality. ``manifest`` has relative_path, sha256
    and rows; bars of files with another verdict than ok stay out.
    """
    raw = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
    tagged = raw.select("*", F.col("_metadata.file_path").alias("_path")).withColumn("relative_path", relative("_path", folder_path(spark, root))).drop("_path")
    counted = tagged.groupBy("relative_path").agg(F.count(F.lit(1)).alias("rows_read"))
    verdicts = manifest_verdicts(spark, root, manifest, pattern, counted)
    return tagged.join(verdicts.filter("verdict = 'ok'").select("relative_path"), "relative_path", "left_semi"), verdicts


def eligible_months(files: DataFrame, quality: DataFrame, universe: DataFrame) -> DataFrame:
    """Symbol-months that are landed, of good quality and in the universe, one row each, with what the universe says of them.

    ``files`` and ``quality`` (``usable``) and ``universe`` are keyed by effective_month and symbol.
    """
    keys = ["effective_month", "symbol"]
    good = quality.filter("usable").select(*keys).distinct()
    return universe.join(files.select(*keys).distinct(), keys, "left_semi").join(good, keys, "left_semi").dropDuplicates(keys)


def read_eligible_months(spark: SparkSession, path: str, eligible: DataFrame) -> DataFrame:
    """Bars of eligible symbol-months with their columns; partitions of months or symbols without any are not read (dynamic partition pruning)."""
    return spark.read.parquet(path).join(eligible, ["effective_month", "symbol"])


def read_json_records(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """JSON documents of a fixed schema, one per line (or file); ``_corrupt`` holds the text of those that do not parse.

    Write the result before asking for ``_corrupt`` alone: Spark does not parse for that column by itself.
    """
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def snapshot_rows(records: DataFrame) -> DataFrame:
    """One row per security of the snapshots that parse: date, state (active or inactive) and the listed fields."""
    good = records.filter("_corrupt IS NULL")
    return good.select(F.to_date("pit_date").alias("pit_date"), "state", F.explode("rows").alias("r")).select("pit_date", "state", "r.*")


def fact_rows(records: DataFrame) -> DataFrame:
    """One row per entry of nested facts: concept, then unit, then entries."""
    good = records.filter("_corrupt IS NULL")
    by_concept = good.select("key", F.explode("facts").alias("concept", "fact"))
    by_unit = by_concept.select("key", "concept", F.col("fact.label").alias("label"), F.explode("fact.units").alias("unit", "entries"))
    rows = by_unit.select("key", "concept", "label", "unit", F.explode("entries").alias("e"))
    return rows.select("key", "concept", "label", "unit", F.to_date("e.end").alias("period_end"), F.to_date("e.filed").alias("filed"), F.col("e.form").alias("form"), F.col("e.val").alias("value"))


def constituents(raw: DataFrame, sector_lists: dict[str, str]) -> DataFrame:
    """Index members: symbols with ``-`` for ``.``, sector, and the list that the sector belongs to (null: none)."""
    key = F.create_map(*[F.lit(x) for pair in sector_lists.items() for x in pair])
    return raw.select(F.translate(F.upper(F.trim("symbol")), ".", "-").alias("symbol"), "sector").withColumn("list_key", key[F.col("sector")])
