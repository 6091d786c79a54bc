"""Density clustering with two entities as the smallest cluster.

A cluster is then a connected component of the graph that joins entities at
most eps apart, and noise is whatever has no neighbour within eps. The graph is
dense, so its edges are never written. Components are found inside each cell and joined
by links to nearest neighbours and between pivots; then every component but the largest of its
group looks into the cells in reach that hold another component, as in a round of
Boruvka's algorithm, and between two cells only enough links are kept to
connect their components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.kernels import components_in_block, constant, linked_labels, matrix
from ..session import cut
from .cells import BLOCK, Cells, build_cells, cogrouped, extend, fields, grouped, meet, nearest, reach, schema_empty, split_large
from .components import connected
from .elbow import sorted_ranks
from .joins import attach

NOISE = -1


def nearest_distances(distinct: DataFrame, keys, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """(keys, id, weight, nid, apart, d): d is the distance to the nearest other entity, 0 for copies.

    `nid` is the nearest other vector and `apart` the distance to it.
    """
    keys = list(keys)
    found = nearest(distinct, keys, 1, block, digits=digits)
    d = F.when(F.col("weight") > 1, F.lit(0.0)).otherwise(F.col("d"))
    known = distinct.select(*keys, "id", "weight").join(found, [*keys, "id"], "left")
    return known.select(*keys, "id", "weight", "nid", F.col("d").alias("apart"), d.alias("d"))


def distance_curve(distances: DataFrame, keys) -> DataFrame:
    """(keys, d, cnt), counting entities, as the elbow rule takes it."""
    return distances.select(*keys, "d", F.col("weight").cast("long").alias("cnt"))


def eps_components(
    distinct: DataFrame, eps: DataFrame, keys, block: int = BLOCK, digits: int | None = None, near: DataFrame | None = None
) -> DataFrame:
    """(keys, id, root): smallest vector id of each component of the eps graph.

    `near` (keys, id, nid, apart), the nearest other vectors if they are known, saves work: vectors
    farther than eps from theirs look nowhere.
    """
    keys = list(keys)
    points = distinct.select(*keys, "id", "vec", "weight")
    small, large, sizes = split_large(points, keys, block)

    def within(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        root = components_in_block(matrix(rows), rows.column("eps")[0].as_py(), digits)
        return rows.select([*keys, "id"]).append_column("root", rows.column("id").take(pa.array(root)))

    schema = extend(fields(points, [*keys, "id"]), root="string")
    result = grouped(attach(small, eps, keys, "id"), keys).applyInArrow(within, schema)
    if large is None:
        return result

    cells = build_cells(large, keys, sizes)

    def inside(rows: pa.Table) -> pa.Table:
        """As `within`; a cell whose radius proves it connected takes no distances."""
        if 2 * rows.column("own").to_numpy().max() * (1 + 1e-9) > rows.column("eps")[0].as_py():
            return within(rows)
        rows = rows.sort_by("id")
        return rows.select([*keys, "id"]).append_column("root", pa.array([rows.column("id")[0].as_py()] * rows.num_rows))

    local = cut(grouped(attach(cells.points, eps, keys, "id"), [*keys, "cell", "sub"]).applyInArrow(inside, schema))
    links = _pivot_links(cells, local, eps, keys, digits)
    if near is not None:
        close = attach(near.join(large.select(*keys, "id"), [*keys, "id"], "left_semi"), eps, keys, "id").filter(F.col("apart") <= F.col("eps"))
        ends = local.select(*keys, F.col("id").alias("nid"), F.col("root").alias("b"))
        links = links.unionByName(
            close.select(*keys, "id", "nid").join(local, [*keys, "id"]).join(ends, [*keys, "nid"]).select(*keys, F.col("root").alias("a"), "b")
        )
    rooted = cut(_joined(local, links, keys))
    cells, asking = eps_visitors(cells, rooted, eps, keys, digits, near)
    going = reach(cells, asking, keys)
    roots = rooted.select(*keys, "id", "root")
    visitors, hosts = meet(cells, asking.drop("bound"), going, cells.points.join(roots, [*keys, "id"]), keys)
    pairs = extend(fields(points, keys), a="string", b="string")

    def across(rows: pa.Table, host: pa.Table) -> pa.Table:
        if not rows.num_rows or not host.num_rows:
            return schema_empty(rows.slice(0, 0).select(keys), a=pa.string(), b=pa.string())
        names = [t.column("root").to_pylist() for t in (rows, host)]
        labels = [np.array(n, dtype=object) for n in names]
        order = {v: i for i, v in enumerate(sorted(set(names[0]) | set(names[1])))}
        codes = [np.array([order[v] for v in n]) for n in labels]
        links = linked_labels(
            matrix(rows), codes[0], matrix(host), codes[1], rows.column("eps")[0].as_py(), digits
        )
        back = list(order)
        return pa.table(
            {
                **constant(rows, keys, len(links)),
                "a": pa.array([back[p] for p, _ in links], pa.string()),
                "b": pa.array([back[q] for _, q in links], pa.string()),
            }
        )

    edges = cogrouped(visitors, hosts, [*keys, "cell", "sub", "salt"]).applyInArrow(across, pairs)
    return result.unionByName(_joined(rooted, edges, keys))


def _joined(state: DataFrame, links: DataFrame, keys) -> DataFrame:
    """(keys, id, root) of `state` after joining its roots by `links` (keys, a, b)."""
    found = connected(links, keys).select(*keys, F.col("id").alias("root"), F.col("root").alias("joined"))
    return state.join(found, [*keys, "root"], "left").select(*keys, "id", F.coalesce("joined", "root").alias("root"))


def _pivot_links(cells: Cells, local: DataFrame, eps: DataFrame, keys, digits: int | None) -> DataFrame:
    """(keys, a, b): roots joined because their cells' pivots, vectors themselves, are at most eps apart.

    Each pivot is held against all pivots of its group, of which there are about sqrt(n).
    """
    homes = cells.points.select(*keys, F.col("id").alias("cell"), "blk").join(cells.table.select(*keys, "cell", "pivot"), [*keys, "cell"])
    roots = local.withColumnRenamed("id", "cell")
    known = cut(attach(homes.join(roots, [*keys, "cell"]), eps, keys, "cell"))
    everywhere = known.select(*keys, "cell", "pivot", "root").join(
        cells.table.select(*keys, "blocks").distinct(), keys
    ).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    schema = extend(fields(known, keys), a="string", b="string")

    def close(mine: pa.Table, all_: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return schema_empty(mine.select(keys), a=pa.string(), b=pa.string())
        names = [t.column("root").to_pylist() for t in (mine, all_)]
        order = {v: i for i, v in enumerate(sorted(set(names[0]) | set(names[1])))}
        codes = [np.array([order[v] for v in n]) for n in names]
        found = linked_labels(matrix(mine, "pivot"), codes[0], matrix(all_, "pivot"), codes[1], mine.column("eps")[0].as_py(), digits)
        back = list(order)
        return pa.table(
            {**constant(mine, keys, len(found)), "a": pa.array([back[p] for p, _ in found], pa.string()), "b": pa.array([back[q] for _, q in found], pa.string())}
        )

    return cogrouped(known, everywhere, [*keys, "blk"]).applyInArrow(close, schema)


def eps_visitors(cells: Cells, rooted: DataFrame, eps: DataFrame, keys, digits: int | None, near: DataFrame | None):
    """(cells with the roots they hold, vectors that have to look for links to other components).

    A link between two components is found from either side, so those of a group's
    largest component wait for the others; noise, if known, has no links at all.
    """
    keys = list(keys)
    slack = 0.0 if digits is None else 10.0**-digits
    placed = cells.points.join(rooted, [*keys, "id"])
    held = placed.groupBy(*keys, "cell").agg(F.min("root").alias("low_root"), F.max("root").alias("high_root"))
    table = cut(cells.table.join(held, [*keys, "cell"]))
    sizes = rooted.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy(*keys).agg(F.max(F.struct("n", "root"))["root"].alias("largest"))
    asking = attach(attach(placed, largest, keys, "id"), eps, keys, "id").filter("root <> largest").drop("largest")
    if near is not None:
        apart = near.select(*keys, "id", "apart")
        asking = asking.join(apart, [*keys, "id"]).filter(F.col("apart") <= F.col("eps")).drop("apart")
    return Cells(cells.points, table), cut(asking.withColumn("bound", F.col("eps") + F.lit(slack)))


def number_clusters(roots: DataFrame, keys) -> DataFrame:
    """(keys, root, cluster): clusters numbered from 0 by their smallest id."""
    ranks = sorted_ranks(roots.select(*keys, "root").distinct().withColumn("cnt", F.lit(1)), keys, "root")
    return ranks.select(*keys, "root", F.col("lo").cast("int").alias("cluster"))


def density_clusters(
    distinct: DataFrame, distances: DataFrame, eps: DataFrame, keys, block: int = BLOCK, digits: int | None = None
) -> DataFrame:
    """(keys, id, cluster): clusters from 0, noise -1.

    `distances` are the nearest-neighbour distances `eps` was chosen from, so
    that a vector whose distance equals eps counts as within it.
    """
    keys = list(keys)
    near = distances if "apart" in distances.columns else None
    roots = eps_components(distinct, eps, keys, block, digits, near)
    known = roots.join(distances.select(*keys, "id", "d"), [*keys, "id"])
    kept = cut(
        attach(known, eps.select(*keys, "eps"), keys, "id").select(
            *keys, "id", "root", (F.col("d") <= F.col("eps")).alias("dense")
        )
    )
    numbers = number_clusters(kept.filter("dense"), keys)
    return (
        kept.join(numbers, [*keys, "root"], "left")
        .select(*keys, "id", F.when(F.col("dense"), F.col("cluster")).otherwise(F.lit(NOISE)).alias("cluster"))
    )


def density_noise(distances: DataFrame, eps: DataFrame, keys, strict: bool = False) -> DataFrame:
    """(keys, id): vectors with no neighbour within eps (below eps if `strict`)."""
    apart = F.col("d") >= F.col("eps") if strict else F.col("d") > F.col("eps")
    return attach(distances, eps, keys, "id").filter(apart).select(*keys, "id")
