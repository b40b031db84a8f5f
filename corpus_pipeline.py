"""Documents to packed training sequences, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents. Rows with a null id or text, empty tables and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm import minhash, packing, quality, secrets
from evq.session import materialize

#: Near-duplicate groups and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


#: Keys of dropped documents (two long values each) up to which they are broadcast, so that texts need no shuffle.
BROADCAST_KEYS = 1_000_000
#: Words of which a tokenizing worker keeps the ids: few, because the executors' heaps are as large as the stages before left them.
KEPT_WORDS = 200_000


def without(docs: DataFrame, dropped: DataFrame, mark) -> DataFrame:
    """``docs`` without the rows whose doc_id and ``mark`` are among ``dropped`` (doc_id, mark); nulls are equal here.

    A set of dropped keys of checked size is broadcast; a larger one meets the documents in a shuffle join.
    """
    dropped = materialize(dropped.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct(), "dropped")
    if dropped.count() <= BROADCAST_KEYS:
        dropped = F.broadcast(dropped)
    same = docs["doc_id"].eqNullSafe(dropped["__id"]) & mark.eqNullSafe(dropped["__mark"])
    return docs.join(dropped, same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the verdict of their host."""
    mark = F.xxhash64("source", "text")
    judged = quality.judge(docs.select("doc_id", "source", "text", mark.alias("mark")), keep=("doc_id", "mark"))
    return without(docs, judged.where("not __q_kept"), mark)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least id."""
    dropped = minhash.groups(docs).where("not kept").withColumn("mark", F.lit(0))
    return without(docs, dropped, F.lit(0))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted again."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, kept=KEPT_WORDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is a written table."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
