"""K-means for every group and every k at once.

Centres for k = 2..29 of all groups and restarts form one table. A group of at
most `block` distinct vectors is a single block, whose steps are repeated in
place by one task. Larger groups are spread over blocks: each step joins the
blocks with the centres still moving and sums the partial results per centre.

Both go the same way: k-means++ picks by a race of hashed numbers that any block can run for
its own vectors, and sums of whole numbers, which are the same in any order. So neither
centres nor inertia depend on how a group is spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions.kernels import (
    centre_sums, closest_centres, constant, cost_limbs, floats, from_limbs, hash_uniform, limb_bits, limbs, matrix, power_above,
    seed_centres, vectors,
)
from ..session import cut, cut_placed
from .cells import BLOCK, cogrouped, extend, fields, grouped, split_large
from .elbow import elbow
from .joins import attach, parts_for, spread

K_MIN, K_MAX = 2, 29
RESTARTS = 10
TOLERANCE = 1e-4
MAX_STEPS = 300
STEP_STRIDE = 1000  # step numbers of one restart


def _restart_hash(h: np.ndarray, restart: int) -> np.ndarray:
    return h + np.int64(restart) * np.int64(STEP_STRIDE * 7919)


def _seeds(rows: pa.Table, restart: int):
    x, w = matrix(rows), floats(rows, "weight")
    h = rows.column("h").to_numpy()
    with np.errstate(over="ignore"):
        return x[seed_centres(x, w, _restart_hash(h, restart), K_MAX)]


class _Scale:
    """The whole-number arithmetic of one group, from its total weight, greatest magnitude and dimensions."""

    def __init__(self, total: float, top: float, dims: int):
        self.total, self.dims, self.bits = total, dims, limb_bits(total)
        self.unit = power_above(top)
        self.square = self.unit**2 * power_above(4.0 * dims)  # no squared distance is greater

    def sums(self, x, w, at, count):
        return centre_sums(limbs(x, self.unit, self.bits), w, at, count)

    def costs(self, w, d, at, count):
        return cost_limbs(w, d, at, count, self.square, self.bits)

    def moved(self, sums, mass, centres):
        """The means; a centre without rows stays where it is."""
        means = from_limbs(sums, self.unit, self.bits) / np.maximum(mass, 1e-300)[:, None]
        return np.where(mass[:, None] > 0, means, centres)

    def inertia(self, costs):
        return float(from_limbs(costs.sum(axis=0), self.square, self.bits)[0])

    def limit(self, inertia):
        """How far the centres may still move together; `inertia` is that of the group's mean."""
        return TOLERANCE * inertia / self.total / self.dims


def _centre_rows(rows: pa.Table, keys, found) -> pa.Table:
    """`found`: (restart, k, centres, inertia, converged) → one row per centre."""
    n = sum(len(f[2]) for f in found)
    return pa.table(
        {
            **constant(rows, keys, n),
            "restart": pa.array(np.concatenate([np.full(len(f[2]), f[0]) for f in found]), pa.int32()),
            "k": pa.array(np.concatenate([np.full(len(f[2]), f[1]) for f in found]), pa.int32()),
            "c": pa.array(np.concatenate([np.arange(len(f[2])) for f in found]), pa.int32()),
            "centre": vectors(np.concatenate([f[2] for f in found])),
            "inertia": pa.array(np.concatenate([np.full(len(f[2]), float(f[3])) for f in found])),
            "converged": pa.array(np.concatenate([np.full(len(f[2]), bool(f[4])) for f in found])),
        }
    )


def kmeans_grid(
    distinct: DataFrame, keys, restarts: int = RESTARTS, seed: int = 0, block: int = BLOCK, steps: int = MAX_STEPS,
    starts: DataFrame | None = None,
) -> DataFrame:
    """(keys, restart, k, c, centre, inertia, converged): the best restart for each k = 2..29.

    `distinct` has (keys, id, vec, weight), weights being counts. A group with fewer than k
    distinct vectors gets one centre per vector and inertia 0. `converged` is false
    where the centres still moved after `steps` steps. With `starts` (keys, k, c, centre)
    the centres begin there, for the k that it has, instead of being drawn.
    """
    keys = list(keys)
    points = distinct.select(*keys, "id", "vec", "weight", F.xxhash64(F.lit(seed), "id").alias("h"))
    schema = extend(
        fields(points, keys), restart="integer", k="integer", c="integer", centre="array<double>", inertia="double", converged="boolean"
    )

    def sweep(rows: pa.Table, given: pa.Table | None = None) -> pa.Table:
        rows = rows.sort_by("id")
        x, w = matrix(rows), floats(rows, "weight")
        scale = _Scale(w.sum(), np.abs(x).max(initial=0), x.shape[1])
        parts = limbs(x, scale.unit, scale.bits)
        whole = np.zeros(len(x), int)
        mean = scale.moved(*centre_sums(parts, w, whole, 1), np.zeros((1, x.shape[1])))
        limit = scale.limit(scale.inertia(scale.costs(w, ((x - mean) ** 2).sum(axis=1), whole, 1)))
        best = {}
        for restart in range(restarts if given is None else 1):
            if given is None:
                seeds = _seeds(rows, restart)
                begin = {k: seeds[:k] for k in range(K_MIN, K_MAX + 1)}
            else:
                k_of = given.column("k").to_numpy()
                begin = {int(k): matrix(given.filter(pa.array(k_of == k)).sort_by("c"), "centre") for k in np.unique(k_of)}
            for k, centres in begin.items():
                converged = False
                for _ in range(steps):
                    at, _ = closest_centres(x, centres)
                    moved = scale.moved(*centre_sums(parts, w, at, len(centres)), centres)
                    shift = ((moved - centres) ** 2).sum()
                    centres = moved
                    if shift <= limit:
                        converged = True
                        break
                at, d = closest_centres(x, centres)
                inertia = scale.inertia(scale.costs(w, d, at, len(centres)))
                if k not in best or inertia < best[k][3]:
                    best[k] = (restart, k, centres, inertia, converged)
        return _centre_rows(rows, keys, list(best.values()))

    small, large, sizes = split_large(points, keys, block)
    if starts is None:
        result = grouped(small, keys).applyInArrow(lambda rows: sweep(rows), schema)
    else:
        starts = starts.select(*keys, F.col("k").cast("int").alias("k"), F.col("c").cast("int").alias("c"), "centre")
        both = cogrouped(small, starts, keys)
        empty = lambda given: given.slice(0, 0).select(keys)
        result = both.applyInArrow(lambda rows, given: sweep(rows, given) if rows.num_rows and given.num_rows else _no_centres(empty(given)), schema)
    if large is None:
        return result
    return result.unionByName(_large_grid(large, sizes, keys, restarts, schema, steps, starts))


def _no_centres(none: pa.Table) -> pa.Table:
    kinds = {"restart": pa.int32(), "k": pa.int32(), "c": pa.int32(), "centre": pa.list_(pa.float64()), "inertia": pa.float64(), "converged": pa.bool_()}
    for name, kind in kinds.items():
        none = none.append_column(name, pa.array([], kind))
    return none


def _large_grid(points: DataFrame, sizes: DataFrame, keys, restarts: int, schema, steps: int, starts: DataFrame | None) -> DataFrame:
    blocks = F.ceil(F.col("n") / F.col("lim")).cast("int")
    here = [*keys, "blk"]
    stats = points.groupBy(*keys).agg(
        F.sum("weight").alias("total"), F.max(F.array_max(F.transform("vec", F.abs))).alias("top"), F.max(F.size("vec")).alias("dims")
    )
    known = cut(sizes.select(*keys, "n", blocks.alias("blocks")).join(stats, keys))
    placed = attach(points, known.drop("n", "dims"), keys, "id")
    # stored already split by block, so that the passes below need not move the vectors
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    # a step is paid for by the partition, so there are as many as its work is worth
    if starts is None:
        ks = range(K_MIN, K_MAX + 1)
        starting = known.withColumn("runs", F.lit(restarts * len(ks))).withColumn("centres", F.lit(restarts * sum(ks)))
    else:
        starting = known.join(starts.groupBy(*keys).agg(F.count_distinct("k").alias("runs"), F.count("*").alias("centres")), keys, "left")
    products = F.sum(F.col("n") * F.col("dims") * F.col("centres")).alias("products")
    work = starting.agg(F.sum("blocks").alias("blocks"), F.sum("runs").alias("runs"), products).first()
    spark = points.sparkSession
    parts = parts_for(spark, work.blocks or 0, work.products or 0)
    few = parts_for(spark, work.runs or 0, 0)
    placed = cut_placed(spread(placed, here, parts))
    counts = known.select(*keys, "blocks")

    def copies(table: DataFrame) -> DataFrame:
        return table.join(counts, keys).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    run = [*keys, "restart", "k"]
    partial = extend(fields(points, keys), restart="integer", k="integer", c="integer", adds="array<double>")

    def step(rows: pa.Table, centres: pa.Table) -> pa.Table:
        """Of each centre, what this block's vectors add to its sums, its weight and its cost."""
        if not rows.num_rows or not centres.num_rows:
            return centres.slice(0, 0).select([*run, "c"]).append_column("adds", vectors(np.zeros((0, 1))))
        centres = centres.sort_by([("restart", "ascending"), ("k", "ascending"), ("c", "ascending")])
        x, w, c = matrix(rows), floats(rows, "weight"), matrix(centres, "centre")
        scale = _Scale(rows.column("total")[0].as_py(), rows.column("top")[0].as_py(), x.shape[1])
        parts = limbs(x, scale.unit, scale.bits)
        adds = np.zeros((len(c), parts.shape[1] + 3))
        tag = centres.column("restart").to_numpy().astype(int) * STEP_STRIDE + centres.column("k").to_numpy()
        starts = np.flatnonzero(np.r_[True, tag[1:] != tag[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(c)]):
            at, d = closest_centres(x, c[a:b])
            sums, mass = centre_sums(parts, w, at, b - a)
            adds[a:b] = np.column_stack([sums, mass, scale.costs(w, d, at, b - a)])
        return centres.select([*run, "c"]).append_column("adds", vectors(adds))

    gone = extend(fields(points, keys), restart="integer", k="integer", c="integer", centre="array<double>", shift="double", limit="double", inertia="double")

    def settle(centres: pa.Table, sums: pa.Table) -> pa.Table:
        """The moved centres of one (group, restart, k), at most 29, and its inertia before the move."""
        centres = centres.sort_by("c")
        old = matrix(centres, "centre")
        scale = _Scale(centres.column("total")[0].as_py(), centres.column("top")[0].as_py(), old.shape[1])
        adds = np.zeros((len(old), 2 * old.shape[1] + 3))
        adds[sums.column("c").to_numpy(), sums.column("pos").to_numpy()] = sums.column("v").to_numpy()
        new = scale.moved(adds[:, :-3], adds[:, -3], old)
        inertia = scale.inertia(adds[:, -2:])
        out = centres.select([*run, "c"]).append_column("centre", vectors(new))
        for name, value in (("shift", ((new - old) ** 2).sum()), ("limit", scale.limit(inertia)), ("inertia", inertia)):
            out = out.append_column(name, pa.array(np.full(len(old), float(value))))
        return out

    def advance(centres: DataFrame) -> DataFrame:
        """`centres` moved by one step. What blocks add is summed per coordinate, in whole numbers."""
        centres = centres.select(*run, "c", "centre")
        added = cogrouped(placed, copies(centres), here, placed=True, parts=parts).applyInArrow(step, partial)
        sums = added.select(*run, "c", F.posexplode("adds").alias("pos", "v")).groupBy(*run, "c", "pos").agg(F.sum("v").alias("v"))
        return cogrouped(centres.join(known.select(*keys, "total", "top"), keys), sums, run, parts=few).applyInArrow(settle, gone)

    middle = placed.groupBy(*keys).agg(F.first("vec").alias("centre")).select(
        *keys, F.lit(0).alias("restart"), F.lit(1).alias("k"), F.lit(0).alias("c"), F.transform("centre", lambda v: v * 0.0).alias("centre")
    )
    limits = cut(advance(cut(advance(cut(middle)))).select(*keys, F.col("limit").alias("most")))
    if starts is None:
        moving = cut(_large_seeds(placed, copies, keys, restarts, parts))
    else:
        mine = starts.join(counts.select(*keys), keys, "left_semi")
        moving = cut(mine.select(*keys, F.lit(0).alias("restart"), "k", "c", "centre"))
    settled = None
    for _ in range(steps):
        stepped = cut(
            advance(moving).join(limits, keys).select(*run, "c", "centre", (F.col("shift") <= F.col("most")).alias("converged"))
        )
        moving = stepped.filter("not converged")
        rested = stepped.filter("converged")
        settled = rested if settled is None else settled.unionByName(rested)
        if moving.isEmpty():
            break
    settled = cut(settled.unionByName(moving) if settled is not None else moving.withColumn("converged", F.lit(False)))
    inertia = cut(advance(settled).filter("c = 0").select(*run, "inertia"))
    best = inertia.groupBy(*keys, "k").agg(F.min(F.struct("inertia", "restart")).alias("b"))
    best = best.select(*keys, "k", F.col("b.restart").alias("restart"), F.col("b.inertia").alias("inertia"))
    return settled.join(best, run).select(*schema.names)


def _large_seeds(placed: DataFrame, copies, keys, restarts: int, parts: int) -> DataFrame:
    """(keys, restart, k, c, centre): first centres of the large groups, by k-means++ as for small ones.

    A pick is the vector that wins a race by weight × squared distance to the picks
    before it; each block sends its winner of each restart, and the best of those is the pick.
    Picks are nested, so one sequence seeds every k. A block finds the distances to all
    earlier picks anew in each round, which is a few hundredths of what the steps after it take.
    """
    offer = extend(fields(placed, keys), restart="integer", loss="double", id="string", vec="array<double>")

    def offers(step: int):
        def best(rows: pa.Table, picks: pa.Table | None) -> pa.Table:
            rows = rows.sort_by("id")
            x, w, h = matrix(rows), floats(rows, "weight"), rows.column("h").to_numpy()
            found, loss, tag = [], [], []
            for restart in range(restarts):
                near = np.full(len(x), np.inf)
                if picks is not None:
                    mine = picks.filter(pa.array(picks.column("restart").to_numpy() == restart)).sort_by("c")
                    if not mine.num_rows:
                        continue
                    for pick in matrix(mine):
                        near = np.minimum(near, ((x - pick) ** 2).sum(axis=1))
                mass = w if picks is None else w * near
                with np.errstate(divide="ignore", over="ignore"):
                    race = np.where(mass > 0, np.log(hash_uniform(_restart_hash(h, restart), step)) / mass, -np.inf)
                at = int(race.argmax())
                if mass[at] > 0:
                    found.append(at)
                    loss.append(-race[at])
                    tag.append(restart)
            out = rows.select([*keys, "id", "vec"]).take(pa.array(found, pa.int64()))
            out = out.append_column("restart", pa.array(tag, pa.int32())).append_column("loss", pa.array(loss, pa.float64()))
            return out.select([*keys, "restart", "loss", "id", "vec"])

        return best

    here = [*keys, "blk"]
    chosen = None
    for step in range(K_MAX):
        kernel = offers(step)
        if chosen is None:
            sent = placed.groupBy(*here).applyInArrow(lambda rows: kernel(rows, None), offer)
        else:
            both = cogrouped(placed, copies(chosen.select(*keys, "restart", "c", "vec")), here, placed=True, parts=parts)
            sent = both.applyInArrow(lambda rows, picks: kernel(rows, picks) if rows.num_rows else _no_offer(picks, keys), offer)
        won = sent.groupBy(*keys, "restart").agg(F.min(F.struct("loss", "id", "vec")).alias("p"))
        won = cut(won.select(*keys, "restart", F.lit(step).alias("c"), "p.vec"))
        if won.isEmpty():
            break
        chosen = won if chosen is None else chosen.unionByName(won)
    k = F.explode(F.sequence(F.greatest(F.col("c") + 1, F.lit(K_MIN)), F.lit(K_MAX))).alias("k")
    return chosen.select(*keys, "restart", k, "c", F.col("vec").alias("centre"))


def _no_offer(picks: pa.Table, keys) -> pa.Table:
    none = picks.slice(0, 0)
    return none.select([*keys, "restart"]).append_column("loss", pa.array([], pa.float64())).append_column(
        "id", pa.array([], pa.string())
    ).append_column("vec", none.column("vec"))


def inertia_curve(grid: DataFrame, keys) -> DataFrame:
    """(keys, k, inertia)."""
    return grid.filter("c = 0").select(*keys, "k", "inertia")


def choose_k(grid: DataFrame, keys) -> DataFrame:
    """(keys, k): elbow of the inertia curve, at most the number of centres there are."""
    curve = inertia_curve(grid, keys).select(*keys, (F.col("k") - F.lit(K_MIN)).alias("i"), F.col("inertia").alias("y"))
    have = grid.groupBy(*keys).agg((F.max("c") + 1).alias("most"))
    return elbow(curve, keys).join(have, list(keys)).select(
        *keys, F.least(F.col("i") + F.lit(K_MIN), F.col("most")).cast("int").alias("k")
    )


def kmeans_labels(distinct: DataFrame, grid: DataFrame, chosen: DataFrame, keys, block: int = BLOCK) -> DataFrame:
    """(keys, id, cluster): closest centre of the sweep at the chosen k; no refit."""
    keys = list(keys)
    sizes = distinct.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = sizes.select(*keys, F.ceil(F.col("n") / F.greatest(F.lit(block), F.sqrt("n"))).cast("int").alias("blocks"))
    rows = attach(distinct.select(*keys, "id", "vec"), sizes, keys, "id").withColumn(
        "blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    ).drop("blocks")
    centres = (
        grid.join(chosen, [*keys, "k"])
        .select(*keys, "c", "centre")
        .join(sizes, keys)
        .withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .drop("blocks")
    )

    def label(rows: pa.Table, centres: pa.Table) -> pa.Table:
        out = rows.select([*keys, "id"])
        if not rows.num_rows or not centres.num_rows:
            return out.slice(0, 0).append_column("cluster", pa.array([], pa.int32()))
        centres = centres.sort_by("c")
        at, _ = closest_centres(matrix(rows), matrix(centres, "centre"))
        return out.append_column("cluster", pa.array(centres.column("c").to_numpy()[at], pa.int32()))

    schema = extend(fields(distinct, [*keys, "id"]), cluster="integer")
    return cogrouped(rows, centres, [*keys, "blk"]).applyInArrow(label, schema)


def cluster_profile(members: DataFrame, keys, names: DataFrame | None = None, above: float = 0.2) -> DataFrame:
    """(keys, cluster, feature, mean): mean scaled feature by cluster.

    `members` has (keys, cluster, vec, weight). Features whose mean exceeds
    `above` in no cluster are left out. With `names` (keys…, feature position,
    name) the position is replaced by the name.
    """
    keys = list(keys)
    means = (
        members.groupBy(*keys, "cluster")
        .agg(Summarizer.metrics("mean").summary(array_to_vector("vec"), F.col("weight")).alias("s"))
        .select(*keys, "cluster", F.posexplode(vector_to_array("s.mean")).alias("feature", "mean"))
    )
    telling = means.filter(F.col("mean") > above).select(*keys, "feature").distinct()
    kept = means.join(telling, [*keys, "feature"], "left_semi").select(*keys, "cluster", "feature", "mean")
    if names is None:
        return kept
    on = [c for c in names.columns if c != "name"]
    return kept.join(names, on).select(*keys, "cluster", F.col("name").alias("feature"), "mean")
