"""Cutting long lineages on a folder every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; make one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="flowsift-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def bound_batches(spark: SparkSession, size: str = "1m") -> None:
    """Let whole texts go to Python workers in Arrow batches of about `size`, unless the session sets a size itself.

    Spark's own bound is 10,000 rows or 64 MB, which both sides of the way hold several times.
    Batches are cut when a plan runs, so the setting stays with the session; no result depends on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from the stored table.

    Used where one table feeds several branches or a loop, so that neither a
    lost executor nor the next branch recomputes what led to it. Stored as
    parquet, so later steps read only the columns they need and the optimizer
    knows the size; plans of loops do not grow with the rounds.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_placed(df: DataFrame) -> DataFrame:
    """Like `cut`, but keeps the hash partitioning of `df` for later joins on the same keys.

    An adaptive plan may still change its partitioning while it runs, so a
    checkpoint of one promises none; this one is planned without.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
