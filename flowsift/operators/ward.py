"""Ward hierarchical clustering, cut at a chosen number of clusters.

Ward linkage is reducible, so all clusters that are each other's nearest can
merge in one round without changing the tree. Groups above `block` distinct
vectors merge in distributed rounds until at most `block` are left; the rest of the tree is built by
one task per group, as for groups that were small to begin with.

Nearest clusters are kept from round to round. For the same reason that rounds are allowed, a merged
cluster is never closer to a third one than both its parts were, so a cluster whose nearest did not
merge still has its nearest. Only new clusters and those whose nearest merged search again, in
cells that only new clusters enter anew.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.kernels import floats, matrix, merge_closest
from ..session import cut
from .cells import BLOCK, Cells, Search, as_cells, choose_pivots, extend, fields, grouped, place, split_large
from .components import follow
from .density import number_clusters
from .joins import attach


def ward_clusters(distinct: DataFrame, chosen: DataFrame, keys, block: int = BLOCK) -> DataFrame:
    """(keys, id, cluster): the k clusters of the Ward tree, numbered by smallest id.

    `distinct` has (keys, id, vec, weight), `chosen` (keys, k).
    """
    keys = list(keys)
    points = distinct.select(*keys, "id", "vec", "weight").withColumn("height", F.lit(0.0))
    small, large, sizes = split_large(points, keys, block)
    if large is None:
        roots = _finish(small, None, chosen, keys).select(*keys, "id", "root")
    else:
        roots = _large_roots(small, large, sizes, chosen, keys, block)
    roots = cut(roots)
    return roots.join(number_clusters(roots, keys), [*keys, "root"]).select(*keys, "id", "cluster")


def _finish(clusters: DataFrame, earlier: DataFrame | None, chosen: DataFrame, keys) -> DataFrame:
    """(keys, id, root, undone): completes each tree and cuts it.

    The k - 1 highest merges are not made; of equal heights, those that absorb the
    smallest ids. So the cut does not depend on how a group was spread over tasks.
    `earlier` holds the highest merges made before, in this order; `undone` says how
    many of those are not to be.
    """
    rows = attach(clusters, chosen, keys, "id")
    none = F.array().cast("array<struct<height:double,id:string>>")
    rows = rows.withColumn("before", none) if earlier is None else attach(rows, earlier, keys, "id", "left").withColumn(
        "before", F.coalesce("before", none)
    )

    def complete(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        merges = merge_closest(matrix(rows), floats(rows, "weight"), floats(rows, "height"))
        names = rows.column("id").to_pylist()
        spare = rows.column("k")[0].as_py() - 1
        tops = [(-h, names[gone], i) for i, (gone, _, h) in enumerate(merges)]
        tops += [(-b["height"], b["id"], None) for b in rows.column("before")[0].as_py()]
        tops = sorted(tops, key=lambda t: t[:2])[: max(spare, 0)]
        skipped = {i for _, _, i in tops if i is not None}
        root = np.arange(rows.num_rows)
        for i, (gone, kept, _) in reversed(list(enumerate(merges))):
            if i not in skipped:
                root[gone] = root[kept]
        undone = len(tops) - len(skipped)
        return (
            rows.select([*keys, "id"])
            .append_column("root", rows.column("id").take(pa.array(root)))
            .append_column("undone", pa.array(np.full(len(root), undone), pa.int32()))
        )

    schema = extend(fields(clusters, [*keys, "id"]), root="string", undone="integer")
    return grouped(rows, keys).applyInArrow(complete, schema)


def _large_roots(small: DataFrame, large: DataFrame, sizes: DataFrame, chosen: DataFrame, keys, block: int) -> DataFrame:
    state, done, merges, rounds = cut(large), small, None, 0
    search = Search(state, keys, 1, True, None)
    pivots = choose_pivots(state, keys, sizes)
    cells = as_cells(place(state, pivots, keys), pivots, keys)
    near = search.among(cells)
    while True:
        pairs = cut(_mutual_pairs(near, keys))
        rounds += 1
        state, made = _merge(state, pairs, keys)
        merges = made if merges is None else merges.unionByName(made)
        ended, state, _ = split_large(state, keys, block)
        done = done.unionByName(ended)
        if state is None:
            break
        state = cut(state)
        cells, near = _next_nearest(search, cells, near, state, pairs, pivots, keys)
    merges = cut(merges)
    top = W.partitionBy(*keys).orderBy(F.col("height").desc(), F.col("id"))
    most = chosen.agg(F.max("k")).first()[0] or 1  # a literal limit, so that few rows of a group meet
    ranked = cut(merges.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") < most))
    earlier = ranked.groupBy(*keys).agg(F.collect_list(F.struct("height", "id")).alias("before"))
    finished = cut(_finish(done, earlier, chosen, keys))
    undone = ranked.join(finished.select(*keys, "undone").distinct(), keys).filter(F.col("rank") <= F.col("undone"))
    kept = merges.join(undone.select(*keys, "id"), [*keys, "id"], "left_anti")
    above = follow(kept, keys, steps=max(1, ceil(log2(rounds + 1))))
    everyone = large.select(*keys, "id").unionByName(small.select(*keys, "id"))
    outer = everyone.join(above, [*keys, "id"], "left").withColumn("outer", F.coalesce("root", "id")).drop("root")
    ends = finished.select(*keys, F.col("id").alias("outer"), F.col("root").alias("end"))
    return outer.join(ends, [*keys, "outer"], "left").select(*keys, "id", F.coalesce("end", "outer").alias("root"))


def _next_nearest(search: Search, cells: Cells, near: DataFrame, state: DataFrame, pairs: DataFrame, pivots: DataFrame, keys):
    """The cells of the clusters left, and their nearest (keys, id, nid, d), after merging `pairs`."""
    ids = [*keys, "id"]
    touched = cut(pairs.select(*ids).unionByName(pairs.select(*keys, F.col("other").alias("id"))))
    alive = state.select(*ids)
    new = state.join(pairs.select(*ids), ids, "left_semi")
    still = alive.join(touched, ids, "left_anti")
    kept = cells.points.drop("sub").join(still, ids, "left_semi")
    cells = as_cells(cut(kept.unionByName(place(new, pivots, keys).select(*kept.columns))), pivots, keys)
    old = near.join(still, ids, "left_semi")
    valid = cut(old.join(touched.withColumnRenamed("id", "nid"), [*keys, "nid"], "left_anti").select(*near.columns))
    asking = cut(alive.join(valid.select(*ids), ids, "left_anti"))
    return cells, cut(valid.unionByName(search.among(cells, asking)))


def _mutual_pairs(near: DataFrame, keys) -> DataFrame:
    """(keys, id, other, cost): clusters that are each other's nearest, id < other."""
    back = near.select(*keys, F.col("id").alias("nid"), F.col("nid").alias("id"))
    return near.join(back, [*keys, "id", "nid"], "left_semi").filter("id < nid").select(
        *keys, "id", F.col("nid").alias("other"), F.col("d").alias("cost")
    )


def _merge(state: DataFrame, pairs: DataFrame, keys):
    """The clusters after merging `pairs`, and the merges as pointers (keys, id, to, height)."""
    right = state.select(*keys, F.col("id").alias("other"), F.col("vec").alias("v2"),
                         F.col("weight").alias("w2"), F.col("height").alias("h2"))
    both = state.join(pairs, [*keys, "id"], "left").join(right, [*keys, "other"], "left")
    total = F.col("weight") + F.col("w2")
    mean = F.zip_with("vec", "v2", lambda a, b: (F.col("weight") * a + F.col("w2") * b) / total)
    paired = F.col("other").isNotNull()
    absorbed = pairs.select(*keys, F.col("other").alias("id"))
    after = cut(
        both.select(
            *keys, "id", "other",
            F.when(paired, mean).otherwise(F.col("vec")).alias("vec"),
            F.when(paired, total).otherwise(F.col("weight")).alias("weight"),
            F.when(paired, F.greatest("cost", "height", "h2")).otherwise(F.col("height")).alias("height"),
        ).join(absorbed, [*keys, "id"], "left_anti")
    )
    made = after.filter(F.col("other").isNotNull()).select(
        *keys, F.col("other").alias("id"), F.col("id").alias("to"), "height"
    )
    return after.drop("other"), made
