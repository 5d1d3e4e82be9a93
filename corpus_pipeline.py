"""From raw transcripts to packed training sequences, in five stages.

Each stage takes the rows its predecessor kept and reads them again from Parquet; all but the
last return the columns of ``documents``. Nothing is sampled or capped on the way.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import exact, near, packing, secrets, toxicity
from cuewright.llm.common import Scratch
from cuewright.llm.queries import held_out

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _transcripts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("vid"), "text")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is among ``kept``'s vid; rows without an id go with NULL."""
    return docs.join(kept.select(F.col("vid").alias("_vid")).distinct(), F.col("doc_id").eqNullSafe(F.col("_vid")), "left_semi") \
        .select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of the toxicity score stay. Held-out labels are never learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("vid"), "toxic")
    rated = toxicity.score(_transcripts(docs), labels.where(~held_out(F.col("vid"))), Scratch(spark))
    return _only(docs, rated.where("toxic = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the one with the smallest doc_id stays."""
    return _only(docs, exact.exact_copies(_transcripts(docs), Scratch(spark)).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, the document with the smallest doc_id stays."""
    return _only(docs, near.near_classes(_transcripts(docs), Scratch(spark)).where("kept"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mask; n_chars follows the text. No document goes."""
    ledger = Scratch(spark).keep(secrets.scan(docs), "ledger")
    return secrets.redact(docs.select(*COLUMNS), ledger).withColumn(
        "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full training sequences, with their ids as little-endian 32-bit numbers."""
    out = packing.pack(_transcripts(docs), Scratch(spark), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumnRenamed("vid", "doc_id").withColumn("ids_crc32", F.crc32("tokens"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("minhash_dedup", drop_near_copies),
          ("secret_scan", mask_secrets), ("packing", pack_tokens)]
ORACLE_SQL = None  # trees, sampling and a tokenizer: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written to the shared folder and read again."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
