"""Registered queries of the text operators, each over its whole table."""
from __future__ import annotations

from pyspark.sql import functions as F

from barloom.session import Scratch

from . import contamination, language, nearest, neardup, packing, passages, secrets, sharding, tokenlinks, topk, toxicity, warc, whitening
from .common import documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op6_benchmark_decontamination")
def op6(spark, sf_dir):
    """Every document's words inside occurrences of benchmark windows."""
    return contamination.leak_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op8_cost_balanced_packing")
def op8(spark, sf_dir):
    """Every document's pieces in sequences of 1,024 tokens."""
    return packing.pack(documents(spark, sf_dir), with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op2_lpt_sharding")
def op2(spark, sf_dir):
    """Every document's shard of 16, balanced by bytes, and its place there."""
    placed = sharding.assign(documents(spark, sf_dir), Scratch(spark))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_warc_writer")
def op3(spark, sf_dir):
    """Every page, archived and read back."""
    scratch = Scratch(spark)
    manifest = warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path(), scratch)
    return warc.read_warc(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op3_warc_writer"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
x AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
y AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM x)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM y"""


@query("op5_maxscore_top_k", """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
           FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""")
def op5(spark, sf_dir):
    """The ten best vectors for every hundredth one."""
    vectors = topk.scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query("op7_subword_toxicity")
def op7(spark, sf_dir):
    """Every document's toxicity."""
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(toxicity.remainder(F.col("doc_id")) == 1, F.lit(False))
    found = toxicity.rate(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op10_word_first_language_id")
def op10(spark, sf_dir):
    """Every document's language."""
    docs = documents(spark, sf_dir)
    model = language.learn(docs.filter(language.in_learning(F.col("doc_id"))))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op9_order_minhash_near_dedup")
def op9(spark, sf_dir):
    """Every document's class of near copies."""
    return neardup.near_classes(documents(spark, sf_dir), Scratch(spark)).select("doc_id", "class_id", "class_docs")


@query("op1_paragraph_minhash")
def op1(spark, sf_dir):
    """Every passage that repeats across documents."""
    return passages.repeated_passages(documents(spark, sf_dir), Scratch(spark))


@query("op4_forest_secret_scan")
def op4(spark, sf_dir):
    """Every candidate of every document, and the forest's verdict."""
    return secrets.scan(documents(spark, sf_dir), Scratch(spark)).select("doc_id", "number", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "secret")


@query("op11_adaptive_dimension_scan")
def op11(spark, sf_dir):
    """The five nearest vectors found for every fiftieth one."""
    return nearest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, Scratch(spark))


@query("op12_external_spill_alignment")
def op12(spark, sf_dir):
    """Every document's alignment of two tokenizers, and what the corpus-wide pair counts say about it."""
    return tokenlinks.align(documents(spark, sf_dir), Scratch(spark))


@query("op13_bidiagonal_qd_whitening")
def op13(spark, sf_dir):
    """Every vector's four whitened components."""
    found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query("pipeline")
def pipeline(spark, sf_dir):
    """Documents through all five stages."""
    import corpus_pipeline  # at the repository's top; the other queries do without it

    return corpus_pipeline.run(spark, sf_dir)
