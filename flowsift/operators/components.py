"""Connected components of a graph given as edges, per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def follow(pointers: DataFrame, keys, steps: int | None = None) -> DataFrame:
    """(keys, id, root): where each chain of (keys, id, to) pointers ends.

    Each step doubles the length covered. Pointers must not form cycles. With
    `steps` that many are made, otherwise as many as it takes.
    """
    keys = list(keys)
    state = cut(pointers.select(*keys, "id", F.col("to").alias("root")))
    done = 0
    while steps is None or done < steps:
        ahead = state.select(*keys, F.col("id").alias("root"), F.col("root").alias("next"))
        moved = state.join(ahead, [*keys, "root"], "left").select(
            *keys, "id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = cut(moved)
        state = moved.drop("moved")
        done += 1
        if steps is None and moved.filter("moved").isEmpty():
            break
    return state


def connected(edges: DataFrame, keys) -> DataFrame:
    """(keys, id, root) for every end of an edge (keys, a, b); root is the smallest id.

    Each round points every node at its smallest neighbour below it, follows
    the pointers, and contracts the graph to the nodes they end in.
    """
    keys = list(keys)
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.filter("a <> b").distinct())
    found = None
    while not both.isEmpty():
        hooks = both.groupBy(*keys, F.col("a").alias("id")).agg(F.min("b").alias("low"))
        hooks = hooks.select(*keys, "id", "low").filter("low < id").withColumnRenamed("low", "to")
        nodes = both.select(*keys, F.col("a").alias("id")).distinct()
        roots = follow(hooks, keys)
        step = cut(nodes.join(roots, [*keys, "id"], "left").withColumn("root", F.coalesce("root", "id")))
        if found is None:
            found = step
        else:
            later = step.select(*keys, F.col("id").alias("root"), F.col("root").alias("next"))
            found = cut(
                found.join(later, [*keys, "root"], "left").select(
                    *keys, "id", F.coalesce("next", "root").alias("root")
                )
            )
        left = step.select(*keys, F.col("id").alias("a"), F.col("root").alias("ra"))
        right = step.select(*keys, F.col("id").alias("b"), F.col("root").alias("rb"))
        both = cut(
            both.join(left, [*keys, "a"])
            .join(right, [*keys, "b"])
            .select(*keys, F.col("ra").alias("a"), F.col("rb").alias("b"))
            .filter("a <> b")
            .distinct()
        )
    if found is None:
        return both.select(*keys, F.col("a").alias("id"), F.col("b").alias("root"))
    return found
