"""Exact neighbour search over groups of any size.

A group with at most `block` vectors is one cell, handled by one task. A larger
group is cut into about sqrt(n) Voronoi cells around pivots from its own vectors: half of them drawn by chance, so
that dense regions get more, half the farthest from those before, so that no region goes without. The
triangle inequality then tells which cells can hold anything within a given
distance of a vector; only those are visited, the most promising first, and each round
of visits lowers the distance beyond which nothing matters. What is stored of visits are ids. All results are exact, whatever
the pivots: they decide the amount of work only.

Where a vector has to look into more cells than a first round visits, a list of visits would carry it to
most of them. Such vectors go on in tiles: cells are dealt to blocks of many thousand vectors, and a vector
travels to each block once, however many of its cells it looks into.

Voronoi pruning for nearest-neighbour joins: Lu, Shen, Chen and Ooi, "Efficient
processing of k nearest neighbor joins using MapReduce", PVLDB 5(10), 2012; spread pivots:
Gonzalez, "Clustering to minimize the maximum intercluster distance", 1985.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.kernels import constant, first_copies, floats, matrix, nearest_by_products, nearest_in_block, row_chunks, sq_distances
from ..functions.scalars import uniform
from ..session import cut
from .joins import attach, spread

BLOCK = 1024
SLACK = 1e-9  # keeps rounding from pruning a cell that holds a tie
SAMPLE = 4  # vectors drawn per pivot to choose
FIRST_VISITS, MORE_VISITS = 4, 8  # cells a vector looks into in the first round, and how much further each later one reaches
SALT_ROWS = 4096  # visitors of a cell that meet in one task
MOST_TILE_PARTS = 4096
TILE_NUMBERS = 1 << 22  # coordinates of one side of a tile
TILE_ROWS, TILE_SIDE = 8192, 8  # groups are cut into blocks of this many vectors until there are so many blocks


@dataclass
class Cells:
    """Vectors with `blk`, `cell`, `sub`, `own` (distance to the pivot), and one row per cell."""

    points: DataFrame
    table: DataFrame


def extend(schema: T.StructType, **added) -> T.StructType:
    """`schema` plus fields given as name=type, with types as in DDL."""
    ddl = ", ".join(f"{name} {kind}" for name, kind in added.items())
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def fields(df: DataFrame, names) -> T.StructType:
    return T.StructType([df.schema[n] for n in names])


def grouped(df: DataFrame, names, parts: int | None = None):
    return spread(df, names, parts).groupBy(*names)


def cogrouped(left: DataFrame, right: DataFrame, names, placed: bool = False, parts: int | None = None):
    """Both tables grouped on `names`; the right side gets columns of its own,
    so that two tables of one origin can meet. With `placed` the left side
    already lies where `spread` would put it."""
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return (left.groupBy(*names) if placed else grouped(left, names, parts)).cogroup(grouped(right, names, parts))


def group_sizes(points: DataFrame, keys, block: int = BLOCK) -> DataFrame:
    """(keys, n, lim, u0): rows of a group and the block length used for it."""
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.min(uniform("id")).alias("u0")).withColumn(
        "lim", F.greatest(F.lit(block), F.ceil(F.sqrt("n")).cast("int"))
    )


def split_large(points: DataFrame, keys, block: int = BLOCK):
    """(groups of one block, larger groups or None, sizes of the larger groups)."""
    large = cut(group_sizes(points, keys, block).filter(F.col("n") > block))
    if large.isEmpty():
        return points, None, large
    names = large.select(*keys)
    return attach(points, names, keys, "id", "left_anti"), attach(points, names, keys, "id", "left_semi"), large


def choose_pivots(points: DataFrame, keys, sizes: DataFrame) -> DataFrame:
    """(keys, cell, pivot, blocks, lim): about sqrt(n) vectors of each large group.

    One task per group sees a sample of some SAMPLE x sqrt(n) vectors.
    """
    keys = list(keys)
    tagged = attach(points, sizes, keys, "id").withColumn("u", uniform("id"))
    wanted = F.ceil(F.sqrt("n")).cast("int").alias("wanted")
    sample = tagged.filter((F.col("u") * F.sqrt("n") < SAMPLE) | (F.col("u") == F.col("u0"))).select(
        *keys, "id", "vec", "u", wanted, F.ceil(F.col("n") / F.col("lim")).cast("int").alias("blocks"), "lim"
    )

    def pick(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("u", "ascending"), ("id", "ascending")])
        taken = spread_picks(matrix(rows), rows.column("wanted")[0].as_py())
        out = rows.take(pa.array(taken)).select([*keys, "id", "vec", "blocks", "lim"])
        return out.rename_columns([*keys, "cell", "pivot", "blocks", "lim"])

    schema = extend(fields(points, keys), cell="string", pivot="array<double>", blocks="integer")
    schema = T.StructType([*schema.fields, T.StructField("lim", sizes.schema["lim"].dataType)])
    return cut(grouped(sample, keys).applyInArrow(pick, schema))


def spread_picks(x: np.ndarray, wanted: int) -> list[int]:
    """Positions of up to `wanted` rows: the first half of them in order, then always the row farthest from all before."""
    taken = list(range(min(len(x), (wanted + 1) // 2)))
    near = np.full(len(x), np.inf)
    for i in taken:
        near = np.minimum(near, sq_distances(x[i : i + 1], x)[0])
    while len(taken) < wanted and near.max(initial=0) > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, sq_distances(x[taken[-1] : taken[-1] + 1], x)[0])
    return taken


def place(points: DataFrame, pivots: DataFrame, keys) -> DataFrame:
    """`points` of large groups with `blk`, `cell` (their nearest pivot's) and `own`, the distance to it.

    Vectors travel in hash blocks of at most about `lim` rows; each block meets
    a copy of its group's pivots.
    """
    keys = list(keys)
    blocks = pivots.groupBy(*keys).agg(F.max("blocks").alias("blocks"))
    tagged = attach(points, blocks, keys, "id").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    columns = [*points.columns, "blk"]
    schema = extend(fields(tagged, columns), cell="string", own="double")

    def nearest_pivot(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema_empty(rows, cell=pa.string(), own=pa.float64())
        pivots = pivots.sort_by("cell")
        at, d = nearest_in_block(matrix(rows), matrix(pivots, "pivot"), np.full(rows.num_rows, -1), 1)
        return rows.append_column("cell", pivots.column("cell").take(pa.array(at[:, 0]))).append_column(
            "own", pa.array(d[:, 0])
        )

    copies = pivots.select(*keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), "cell", "pivot")
    return cut(cogrouped(tagged.select(*columns), copies, [*keys, "blk"]).applyInArrow(nearest_pivot, schema))


def as_cells(placed: DataFrame, pivots: DataFrame, keys) -> Cells:
    """Cells of vectors that `place` has placed; cells of more than `lim` vectors have several parts, `sub`."""
    keys = list(keys)
    stats = placed.groupBy(*keys, "cell").agg(
        F.count("*").alias("count"), F.max("own").alias("radius"), F.min("weight").alias("lightest")
    )
    table = cut(
        pivots.join(stats, [*keys, "cell"]).withColumn("subs", F.ceil(F.col("count") / F.col("lim")).cast("int"))
    )
    sub = F.pmod(F.xxhash64(F.lit("sub"), F.col("id")), F.col("subs")).cast("int")
    points = placed.join(table.select(*keys, "cell", "subs"), [*keys, "cell"]).withColumn("sub", sub).drop("subs")
    return Cells(cut(points), table)


def build_cells(points: DataFrame, keys, sizes: DataFrame) -> Cells:
    """Assigns every vector of the large groups to its nearest pivot."""
    pivots = choose_pivots(points, keys, sizes)
    return as_cells(place(points, pivots, keys), pivots, keys)


def schema_empty(rows: pa.Table, **more) -> pa.Table:
    for name, kind in more.items():
        rows = rows.append_column(name, pa.array([], type=kind))
    return rows


def reach(cells: Cells, bounded: DataFrame, keys, first: int = 0, last: int | None = None, ward: bool = False) -> DataFrame:
    """(keys, id, cell): which cells vectors must look into; of each vector's list the places from `first` to before `last`.

    `bounded` are vectors of `cells.points` with `bound`, the value beyond which nothing
    matters. A vector's own cell comes first, the others by what they could hold at best. With a column
    `root` in `bounded` and `low_root`, `high_root` in the cells' table, cells that
    hold only vectors of the vector's own root are left out.
    """
    keys = list(keys)
    schema = extend(fields(bounded, [*keys, "id"]), cell="string")
    rooted = "root" in bounded.columns

    def lists(rows: pa.Table, cells_: pa.Table) -> pa.Table:
        plain = rows.select([*keys, "id"])
        if not rows.num_rows:
            return schema_empty(plain, cell=pa.string())
        cells_ = cells_.sort_by("cell")
        own = floats(rows, "own")
        x, pivots = matrix(rows), matrix(cells_, "pivot")
        names = {c: i for i, c in enumerate(cells_.column("cell").to_pylist())}
        at = np.array([names[c] for c in rows.column("cell").to_pylist()])
        bound, radius = floats(rows, "bound"), floats(cells_, "radius")
        if rooted:
            low_root, high_root, root = (np.array(c.to_pylist(), object) for c in (cells_.column("low_root"), cells_.column("high_root"), rows.column("root")))
            single = np.where(low_root == high_root, low_root, None)
        taken = []
        for part in row_chunks(len(x), len(pivots)):
            d = np.sqrt(sq_distances(x[part], pivots))
            apart = np.sqrt(sq_distances(pivots[at[part]], pivots))
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 0, (d**2 - own[part, None] ** 2) / (2 * apart), 0.0)
            slack = SLACK * (d + radius[None, :])
            low = np.maximum(np.maximum(d - radius[None, :], plane) - slack, 0.0)
            if ward:
                w, light = floats(rows, "weight")[part, None], floats(cells_, "lightest")[None, :]
                low = low**2 * (w * light / (w + light))
            wanted = low <= bound[part, None] * (1 + SLACK)
            if rooted:
                wanted &= single[None, :] != root[part, None]
            if last is not None and last < len(pivots) and not ward:  # the first places only, without ordering the rest
                low = np.where(wanted, low, np.inf)
                low[np.arange(len(d)), at[part]] = np.where(wanted[np.arange(len(d)), at[part]], -1.0, np.inf)
                front = low.argpartition(last - 1, axis=1)[:, :last]
                wanted &= False
                np.put_along_axis(wanted, front, np.isfinite(np.take_along_axis(low, front, axis=1)), axis=1)
            i, j = np.nonzero(wanted)
            order = np.lexsort((j, np.where(j == at[part][i], -1.0, low[i, j]), i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            seen = (rank >= first) & (rank < (len(pivots) if last is None else last))
            taken.append((i[seen] + part.start, j[seen]))
        i, j = (np.concatenate(c) for c in zip(*taken))
        return plain.take(pa.array(i)).append_column("cell", cells_.column("cell").take(pa.array(j)))

    more = ["low_root", "high_root"] if rooted else []
    copies = cells.table.select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), "cell", "pivot", "radius", "lightest", *more
    )
    return cut(cogrouped(bounded, copies, [*keys, "blk"]).applyInArrow(lists, schema))


def meet(cells: Cells, visitors: DataFrame, going: DataFrame, hosts: DataFrame, keys, salt_rows: int = SALT_ROWS):
    """Visitors and hosts, both with (keys, cell, sub, salt) to be cogrouped on.

    `going` are the lists of `reach`, `visitors` and `hosts` vectors of `cells.points` with what
    the kernel needs. A vector does not visit the part of a cell that it lies in; visitors of a popular cell
    are salted over several copies of it.
    """
    keys = list(keys)
    parts = cells.table.select(*keys, "cell", "subs")
    theirs = visitors.withColumnRenamed("cell", "home").withColumnRenamed("sub", "home_sub").drop("blk", "own")
    arriving = (
        going.join(parts, [*keys, "cell"])
        .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        .drop("subs")
        .join(theirs, [*keys, "id"])
        .filter((F.col("cell") != F.col("home")) | (F.col("sub") != F.col("home_sub")))
    )
    spot = [*keys, "cell", "sub"]
    counts = going.groupBy(*keys, "cell").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts"))
    salts = parts.join(counts, [*keys, "cell"]).select(
        *keys, "cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "salts"
    )
    arriving = arriving.join(salts, spot).withColumn(
        "salt", F.pmod(F.xxhash64(F.lit("salt"), F.col("id")), F.col("salts")).cast("int")
    )
    waiting = hosts.join(salts, spot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return arriving.drop("salts"), waiting.drop("salts", "blk", "own")


def tile_sides(points: DataFrame, keys, rows: int = TILE_ROWS, side: int = TILE_SIDE) -> DataFrame:
    """(keys, side): into how many blocks each group is cut for its tiles."""
    volume = F.sum(F.size("vec").cast("double"))
    return points.groupBy(*keys).agg(
        F.greatest(
            F.ceil(volume / TILE_NUMBERS), F.least(F.lit(side).cast("long"), F.ceil(F.count("*") / rows)), F.lit(1).cast("long")
        ).cast("int").alias("side")
    )


def tile(visitors: DataFrame, hosts: DataFrame, sides: DataFrame, keys, by):
    """Visitors and hosts grouped on (keys, row, col): every vector's block meets every block of its group.

    Blocks are hashed on the columns `by`.
    """
    keys = list(keys)
    count = sides.agg(F.sum(F.col("side").cast("long") * F.col("side"))).first()[0] or 1
    parts = max(int(sides.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(count), MOST_TILE_PARTS))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        tagged = attach(df, sides, keys, "id").withColumn(own, F.pmod(F.xxhash64(F.lit("tile"), *by), F.col("side")).cast("int"))
        copied = tagged.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("side") - 1))).drop("side")
        copied = copied.select(*[F.col(c).alias(c) for c in copied.columns])
        return copied.repartition(parts, *keys, "row", "col").groupBy(*keys, "row", "col")

    return dealt(visitors, "row", "col").cogroup(dealt(hosts, "col", "row"))


class Search:
    """Nearest-neighbour kernels for one set of keys and one measure."""

    def __init__(self, points: DataFrame, keys, k: int, ward: bool, digits: int | None):
        self.keys, self.k, self.ward, self.digits = list(keys), k, ward, digits
        self.schema = extend(fields(points, [*self.keys, "id"]), nid="string", d="double")

    def best(self, a: pa.Table, b: pa.Table, own) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema_empty(a.slice(0, 0).select([*self.keys, "id"]), nid=pa.string(), d=pa.float64())
        weights = (floats(a, "weight"), floats(b, "weight")) if self.ward else (None, None)
        at, d = nearest_in_block(matrix(a), matrix(b), own, self.k, *weights)
        i, j = np.nonzero(np.isfinite(d))
        out = a.select([*self.keys, "id"]).take(pa.array(i))
        value = d[i, j] if self.digits is None else np.round(d[i, j], self.digits)
        return out.append_column("nid", b.column("id").take(pa.array(at[i, j]))).append_column("d", pa.array(value))

    def within(self, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        return self.best(rows, rows, np.arange(rows.num_rows))

    def across(self, visitors: pa.Table, hosts: pa.Table) -> pa.Table:
        return self.best(visitors, hosts.sort_by("id"), np.full(visitors.num_rows, -1))

    def in_tile(self, visitors: pa.Table, hosts: pa.Table, part=()) -> pa.Table:
        """The k best of `hosts` for each of `visitors`, up to its `bound` if it has one, without itself.

        Hosts that are equal in columns `part` lie together and are skipped together. Of equal
        hosts only the first k + 1 can be neighbours of anything.
        """
        if not visitors.num_rows or not hosts.num_rows:
            return self.best(visitors, hosts.slice(0, 0), None)
        hosts = hosts.sort_by("id")
        hosts = hosts.take(pa.array(first_copies(matrix(hosts), self.k + 1)))
        order = np.arange(hosts.num_rows)
        edges = np.r_[np.arange(0, hosts.num_rows, BLOCK), hosts.num_rows]
        if part:
            hosts = hosts.append_column("_order", pa.array(order)).sort_by([(c, "ascending") for c in (*part, "id")])
            order = hosts.column("_order").to_numpy()
            starts = np.zeros(hosts.num_rows, dtype=bool)
            for c in part:
                codes = hosts.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
                starts[1:] |= codes[1:] != codes[:-1]
            starts[0] = True
            edges = np.r_[np.flatnonzero(starts), hosts.num_rows]
            visitors = visitors.sort_by([(c, "ascending") for c in part])
        x, y = matrix(visitors), matrix(hosts)
        names = {(v, row.tobytes()): i for i, (v, row) in enumerate(zip(hosts.column("id").to_pylist(), y))}
        own = np.array([names.get((v, row.tobytes()), -1) for v, row in zip(visitors.column("id").to_pylist(), x)])
        bound = floats(visitors, "bound") if "bound" in visitors.column_names else np.full(len(x), np.inf)
        at, d = nearest_by_products(x, y, own, self.k, bound, order, edges)
        i, j = np.nonzero(np.isfinite(d))
        out = visitors.select([*self.keys, "id"]).take(pa.array(i))
        value = d[i, j] if self.digits is None else np.round(d[i, j], self.digits)
        return out.append_column("nid", hosts.column("id").take(pa.array(at[i, j]))).append_column("d", pa.array(value))

    def by_tiles(self, cells: Cells, bounded: DataFrame) -> DataFrame:
        """(keys, id, nid, d) for the vectors `bounded`, from all cells within their `bound`."""
        keys, part = self.keys, ["cell", "sub"]
        sides = cut(tile_sides(cells.points, keys))
        columns = [*keys, "id", "vec", *part]
        met = tile(bounded.select(*columns, "bound"), cells.points.select(*columns), sides, keys, part)
        found = met.applyInArrow(lambda visitors, hosts: self.in_tile(visitors, hosts, part), self.schema)
        return self.merged(found)

    def merged(self, found: DataFrame) -> DataFrame:
        """The k best of what was found per vector; every task keeps its own k best before the shuffle."""
        if self.k == 1:
            one = found.groupBy(*self.keys, "id").agg(F.min(F.struct("d", "nid")).alias("p"))
            return one.select(*self.keys, "id", "p.nid", "p.d")
        closest = F.row_number().over(W.partitionBy(*self.keys, "id").orderBy("d", "nid"))
        return found.withColumn("rank", closest).filter(F.col("rank") <= self.k).drop("rank")

    def among(self, cells: Cells, queries: DataFrame | None = None) -> DataFrame:
        """(keys, id, nid, d) for the vectors of `cells`, or for those of `queries` (keys, id) only.

        A vector starts in its own cell; a round visits further cells, the most
        promising first, with the bound that its own has left. Vectors that have yet more cells in reach
        then go through tiles; Ward costs go on in rounds of visits instead.
        """
        keys = self.keys
        asking = cells.points if queries is None else cells.points.join(queries.select(*keys, "id"), [*keys, "id"], "left_semi")
        if queries is None:
            found = cut(grouped(asking, [*keys, "cell", "sub"]).applyInArrow(lambda rows: self.within(rows), self.schema))
        else:
            asking = cut(asking)
            names = asking.select(*keys, "cell", "sub").distinct()
            hosts = cells.points.join(names, [*keys, "cell", "sub"], "left_semi")
            kernel = cogrouped(asking, hosts, [*keys, "cell", "sub"])
            found = cut(kernel.applyInArrow(lambda asking, hosts: self.at_home(asking, hosts), self.schema))
        first, last = 0, FIRST_VISITS
        while True:
            kth = found.groupBy(*keys, "id").agg(F.max("d").alias("bound"), F.count("*").alias("have"))
            bound = F.when(F.col("have") >= self.k, F.col("bound")).otherwise(F.lit(float("inf")))
            bound = bound if self.digits is None else bound + F.lit(10.0**-self.digits)
            bounded = asking.join(kth, [*keys, "id"], "left").withColumn("bound", bound).drop("have")
            listed = last if self.ward or not first else first + 1  # a vector with tiles ahead needs no list
            going = reach(cells, bounded, keys, first, listed, self.ward)
            if going.isEmpty():
                return found
            if first and not self.ward:
                asked = going.select(*keys, "id").distinct()
                rest = self.by_tiles(cells, bounded.join(asked, [*keys, "id"], "left_semi"))
                return found.join(asked, [*keys, "id"], "left_anti").unionByName(cut(rest))
            visitors, hosts = meet(cells, asking, going, cells.points, keys)
            more = cogrouped(visitors, hosts, [*keys, "cell", "sub", "salt"]).applyInArrow(lambda visitors, hosts: self.across(visitors, hosts), self.schema)
            found = cut(self.merged(found.unionByName(more)))
            first, last = last, last * MORE_VISITS

    def at_home(self, asking: pa.Table, hosts: pa.Table) -> pa.Table:
        """Neighbours of `asking` in the part of the cell that they lie in themselves."""
        if not asking.num_rows:
            return self.best(asking, hosts, None)
        hosts = hosts.sort_by("id")
        names = {v: i for i, v in enumerate(hosts.column("id").to_pylist())}
        return self.best(asking, hosts, np.array([names[v] for v in asking.column("id").to_pylist()]))


def nearest(points: DataFrame, keys, k: int = 1, block: int = BLOCK, ward: bool = False, digits: int | None = None) -> DataFrame:
    """(keys, id, nid, d): the k nearest other vectors of the same group.

    `points` has (keys, id, vec, weight) and should be cheap to read again.
    Ties go to the smaller id. With `ward`, d is the Ward merge cost.
    """
    points = points.select(*keys, "id", "vec", "weight")
    search = Search(points, keys, k, ward, digits)
    small, large, sizes = split_large(points, keys, block)
    result = grouped(small, keys).applyInArrow(lambda rows: search.within(rows), search.schema)
    if large is None:
        return result
    return result.unionByName(search.among(build_cells(large, keys, sizes)))
