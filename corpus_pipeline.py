"""From raw documents to packed training sequences, a stage at a time.

Every stage takes all rows its predecessor kept. All but the last return the columns
of `documents`; each result is stored and read again as the next stage's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.llm import decontaminate, lines, minhash, packing, quality
from flowsift.llm.queries import word_tokenizer
from flowsift.llm.tables import fresh, table
from flowsift.session import bound_batches, ensure_checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    bound_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go, and documents of which nothing but white space is left by that."""
    dropped = fresh(docs, "lines_dropped")
    short = lines.dedup_lines(docs, dropped=dropped)
    left = (F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = short.filter(F.coalesce(left, F.lit(True)))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(changed, "n_chars"))
    return out.select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    bound_batches(spark)
    return minhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    bound_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left, packed into sequences."""
    bound_batches(spark)
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]

#: The first stage is a trained model and the last a linear program; tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage's result is stored in the shared folder."""
    home = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{home}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
