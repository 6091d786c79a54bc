"""Moving rows so that no group, however large, ends up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SALTS = 64
CALL, PART = 10**6, 10**8  # operations that the call of a kernel is worth, and a partition of a loop


def attach(rows: DataFrame, per_group: DataFrame, keys, by: str, how: str = "inner") -> DataFrame:
    """`rows` joined on `keys` with a table that has one row per group.

    A group may hold a third of all rows, so a join on its keys alone would put
    them into one task, and a following aggregate would keep them there. The
    small side is copied over salts and `rows` are salted by column `by`: a group
    is spread from the start, and adaptive execution may still broadcast the
    small side or split further.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame, names, parts: int | None = None) -> DataFrame:
    """`df` hashed on `names` over all shuffle partitions, or over `parts`.

    Block kernels cost far more than the bytes they read, so their partitions
    must not be merged by size; a repartition with a given number never is.
    """
    return df.repartition(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *names)


def parts_for(spark: SparkSession, calls: int, operations: int) -> int:
    """Partitions worth their start, at most all shuffle partitions, for kernels called `calls` times that do `operations` in all.

    For loops, whose every round pays for each partition again.
    """
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, -(-(calls * CALL + operations) // PART)))
