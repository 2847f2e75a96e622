"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes every stage's table and reads it back for the next.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import contamination, language, neardup, packing, secrets
from barloom.llm.common import documents
from barloom.session import Scratch


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language; texts that are null or have no letter go, and those that no language fits."""
    return language.keep_identified(docs, least=0.3)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies."""
    return neardup.keep_one(docs, Scratch(spark))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return contamination.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return secrets.redact(docs, Scratch(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("minhash_near_dedup", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("secret_scan", redacted),
    ("packing", packed),
]

#: SQL has no tokenizer, no forest and no order sketches; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
