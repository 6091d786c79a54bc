"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from ..session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids that may be sent to all executors; as a hash table some 150 MB.
FEW_IDS = 1 << 22


def by_ids(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """`rows` with a `doc_id` that is in the one column of `ids`, or with `how="left_anti"` those without.

    Up to FEW_IDS ids, counted first, go to the rows, so that no text moves; more are
    joined by a shuffle of both sides.
    """
    ids = cut(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids.hint("merge"), "doc_id", how)


def spread_ranks(df: DataFrame, keys, by, rows_per_block: int = 4096) -> DataFrame:
    """`df` with `_rank`, gapless from 0 within each value of `keys`, in no given order.

    A key may hold most rows, so each key is dealt by the hash of columns `by` into
    blocks of about `rows_per_block` rows; rows are numbered inside their block and
    blocks are laid end to end. Only the per-block counts meet by key. `df` is read
    twice and must give the same rows each time (a stored table, say).
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    blocks = sizes.select(*keys, F.ceil(F.col("_n") / rows_per_block).cast("long").alias("_blocks"))
    dealt = cut(
        df.join(F.broadcast(blocks) if _few(blocks) else blocks, keys).withColumn(
            "_block", F.pmod(F.xxhash64(*by), F.col("_blocks"))
        )
    )
    counts = dealt.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = W.partitionBy(*keys, "_block").orderBy(*by)
    return (
        dealt.withColumn("_row", F.row_number().over(inside))
        .join(starts, [*keys, "_block"])
        .withColumn("_rank", F.col("_first") + F.col("_row") - 1)
        .drop("_row", "_first", "_block", "_blocks")
    )


def _few(df: DataFrame, limit: int = 100_000) -> bool:
    """Whether `df` has at most `limit` rows; reads no more than one row beyond that."""
    return df.limit(limit + 1).count() <= limit


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ordered_ranks(df: DataFrame, keys, order, name: str = "_rank") -> DataFrame:
    """`df` with `name`, gapless from 0 within each value of `keys`, in the order of columns `order`.

    Rows are range-partitioned on keys and order together, so one key may span many
    partitions; each partition numbers its own rows and the counts of earlier ones are
    added. Only those counts meet by key.
    """
    keys, order = list(keys), list(order)
    part, row, first = (fresh(df, c) for c in ("part", "row", "first"))
    n = wide_partitions(df.sparkSession)
    placed = cut(df.repartitionByRange(n, *keys, *order).withColumn(part, F.spark_partition_id()))
    counts = placed.groupBy(*keys, part).agg(F.count("*").alias(row))
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias(k + "__") for k in keys), F.col(part).alias(part + "__"), F.coalesce(F.sum(row).over(before), F.lit(0)).alias(first))
    same = F.col(part) == F.col(part + "__")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(k + "__"))
    numbered = placed.withColumn(row, F.row_number().over(W.partitionBy(*keys, part).orderBy(*order)))
    joined = numbered.join(starts, same)
    return joined.select(*df.columns, (F.col(first) + F.col(row) - 1).alias(name))
