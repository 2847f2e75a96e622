"""Deterministic sharded WARC archives: writing with revisits, and reading back."""
from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import Scratch

#: Payload bytes of a shard, and compressed bytes after which a file of a shard ends.
SHARD_BYTES, ROLL_BYTES = 32 << 20, 64 << 20
#: Payloads below this are never revisits.
REVISIT_BYTES = 1000
#: The date that regenerated headers carry unless the caller gives one.
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("sha1", T.StringType())])
RECORDS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
                        T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())])


def file_system(folder: str):
    """The file system of a folder that all executors see, and the path in it."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(folder)


def record_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A compressed WARC record; a revisit (``refers_to`` given) leaves the payload out but tells its length and digest."""
    digest = hashlib.sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_uri(page_id, digest.hexdigest()), "WARC-Date": date,
        "WARC-Target-URI": None if url is None else " ".join(url.split()), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest.digest()).decode()}",
        "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Length": str(len(block)), "X-Page-Id": None if page_id is None else str(page_id),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_uri(refers_to, digest.hexdigest()), "X-Refers-To-Page": str(refers_to)}
    text = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items() if v is not None) + b"\r\n"
    return gzip.compress(text + block + b"\r\n\r\n", 6, mtime=0)


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive; raises on a block whose digest differs."""
    with gzip.GzipFile(fileobj=stream) as lines:
        while first := lines.readline():
            if first != VERSION + b"\r\n":
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            head = {}
            while (line := lines.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                head[name] = value.strip()
            block = lines.read(int(head["Content-Length"]))
            if base64.b32encode(hashlib.sha1(block).digest()).decode() != head["WARC-Block-Digest"].removeprefix("sha1:"):
                raise ValueError(f"digest differs in {head['WARC-Record-ID']}")
            lines.read(4)
            yield head, block


def page_of(head: dict[str, str], block: bytes) -> tuple:
    """A row of ``RECORDS``; a revisit's payload digest and length come from its headers."""
    http, _, payload = block.partition(b"\r\n\r\n")
    told = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != told:
        raise ValueError(f"payload digest differs in {head['WARC-Record-ID']}")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda name: int(head[name]) if name in head else None
    return number("X-Page-Id"), head.get("WARC-Target-URI"), length, told, head["WARC-Type"], number("X-Refers-To-Page"), None if revisit else payload


def plan(pages: DataFrame, scratch: Scratch, shard_bytes: int) -> tuple[DataFrame, list[tuple]]:
    """Which pages are revisits of which (page_id, digest, refers_to), and the first key of every shard.

    Only ids, digests and sizes are sorted here. Shards are cut at multiples of ``shard_bytes`` of the running payload size in the order of
    (page_id, digest), so they depend on the rows alone, not on partitions or samples.
    """
    narrow = scratch.keep(pages.select("page_id", "digest", F.octet_length("html").cast("bigint").alias("n")))
    large = narrow.filter(F.col("n") >= REVISIT_BYTES)
    first = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 and refers_to is not null")
    revisits = large.join(first, "digest").filter("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to").distinct()
    ordered = scratch.keep(narrow.orderBy("page_id", "digest").withColumn("part", F.spark_partition_id()))
    sums, before, total = ordered.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect(), [], 0
    for r in sums:
        before.append((r["part"], total))
        total += r["n"]
    if not before:
        return revisits, []
    running = F.sum("n").over(Window.partitionBy("part").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = ordered.withColumn("at", running).join(F.broadcast(pages.sparkSession.createDataFrame(before, "part int, before bigint")), "part")
    starts = placed.groupBy(F.floor((F.col("at") + F.col("before")) / shard_bytes).alias("shard")).agg(F.min(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "digest")).alias("first"))
    return revisits, [(r["first"]["has"], r["first"]["page_id"] or 0, r["first"]["digest"]) for r in starts.orderBy("shard").collect()]


def write_warc(pages: DataFrame, folder: str, scratch: Scratch, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Archive ``page_id, url, html`` rows in ``folder``; returns the manifest (also kept there as Parquet).

    Of rows with equal payloads of at least 1,000 bytes, the one with the largest page_id is a response, the others are revisits of it.
    Rows are sorted by page_id (nulls first), then digest; the same rows give the same files. A task writes each file under a temporary
    name and renames it once complete; a second attempt writes the same bytes to the same name. Files count only if the manifest
    lists them. Null payloads are empty; null urls have no header; rows with equal ids and payloads are written each.
    """
    from bisect import bisect_right

    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    revisits, starts = plan(pages, scratch, shard_bytes)
    revisits = scratch.keep(revisits)
    keys = pages.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, digest: pd.Series) -> pd.Series:
        at = [max(0, bisect_right(keys.value, (p == p and p is not None, 0 if p != p or p is None else int(p), d)) - 1) for p, d in zip(page_id, digest)]
        return pd.Series(at, dtype="int32")

    id_text = F.col("page_id").cast("string")  # whole numbers of 64 bits do not survive nulls as floats
    rows = pages.withColumn("refers_to", F.lit(None).cast("bigint")).withColumn("told", F.lit(False)).unionByName(revisits.withColumn("url", F.lit(None).cast("string")).withColumn("html", F.lit(None).cast("string")).withColumn("told", F.lit(True)))
    rows = rows.withColumn("shard", shard_of(id_text, "digest"))
    dealt = rows.repartitionById(max(1, len(starts)), F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", F.desc("told"), "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        done: list[tuple] = []
        out = name = temporary = None
        shard, roll, size, count, told, digest = None, 0, 0, 0, None, None

        def end():
            nonlocal out
            if out is not None:
                out.close()
                files.move(temporary, name)
                done.append((shard, f"{folder}/{name.rpartition('/')[2]}", count, size, digest.hexdigest()))
                out = None

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["page_id"], r["digest"])
                if r["told"]:
                    told = (key, r["refers_to"])
                    continue
                if r["shard"] != shard or size >= roll_bytes:
                    end()
                    roll = roll + 1 if r["shard"] == shard else 0
                    shard, size, count, digest = r["shard"], 0, 0, hashlib.sha1()
                    name = f"{base}/part-{shard:06d}-{roll:04d}.warc.gz"
                    temporary = f"{base}/.part-{shard:06d}-{roll:04d}-{task.stageId()}-{task.taskAttemptId()}.tmp"
                    out = files.open_output_stream(temporary, compression=None)
                data = record(r["page_id"], r["url"], (r["html"] or "").encode(), told[1] if told and told[0] == key else None, date)
                out.write(data)
                digest.update(data)
                size, count = size + len(data), count + 1
        end()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 5, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=MANIFEST.names)

    dealt.mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files that a manifest lists; a file is one task's work and is streamed record by record."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, path = file_system(name)
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for head, block in read_records(stream):
                        row = page_of(head, block)
                        held += len(row[6] or b"") if payloads else 0
                        rows.append(row if payloads else (*row[:6], None))
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=RECORDS.names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=RECORDS.names)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file").repartition(n, "file").mapInArrow(read, RECORDS)
