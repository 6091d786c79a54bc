"""Embedding whitening on the leading components, by contour integration.

Entries are scaled to whole numbers, so counts, sums and products add up exactly in
whatever order the tasks end: two passes over the vectors give the covariance, whose
size is that of the vectors' dimension squared and of nothing else. Its eigenvectors come from
FEAST: E. Polizzi, "Density-matrix-based algorithm for solving eigenvalue problems",
Phys. Rev. B 79 (2009). The solutions of complex shifted systems, summed over the nodes of
a quadrature on a circle, project a block of vectors onto the eigenvalues inside it;
Rayleigh-Ritz extracts the pairs, and this repeats until they settle. Where circles go, and that no
eigenvalue inside was missed, is told by inertia: the signs of the pivots of a shifted
symmetric elimination (Bunch and Kaufman) count the eigenvalues below the shift. Each circle is
a task. A last pass projects all vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut

SCALE, SHIFT = 1024, 100_000
LIMIT = 1 << 30  # of a scaled entry's magnitude: squares of differences stay exact
NODES = 8  # of the quadrature on half a circle
PER_CIRCLE = 8  # eigenvalues a circle is to hold
ROUNDS = 40
EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    """What the fit found. Components are columns, by falling eigenvalue."""

    n: int
    sums: list  # of the scaled entries, exact
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


# -- the covariance -------------------------------------------------------------------


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding): the rows whose vector has only finite entries and the commonest length (the greater of equally common ones)."""
    finite = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    good = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(finite & (F.size("embedding") > 0))
    size = F.size("embedding").alias("size")
    lengths = good.groupBy(size).agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("size")).first()
    return good.filter(F.size("embedding") == (lengths["size"] if lengths else 0))


def _scaled(column: pa.Array) -> np.ndarray:
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE) + SHIFT
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError(f"an entry of magnitude {(LIMIT - SHIFT) // SCALE} or more cannot be scaled exactly")
    return x.astype(np.int64).reshape(len(column), -1)


def _whole(numbers) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in numbers], pa.decimal128(38, 0))


def exact_sums(rows: DataFrame) -> tuple[int, list]:
    """(n, sums): how many vectors, and their scaled entries' sum per dimension."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = _scaled(batch.column(0)).sum(0).astype(object)
                n, total = n + batch.num_rows, part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([n] * len(total)), _whole(total)], ["i", "n", "s"])

    parts = rows.select("embedding").mapInArrow(run, "i long, n long, s decimal(38,0)")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (int(found[0]["n"]) if found else 0), [int(r["s"]) for r in found]


def covariance(rows: DataFrame, n: int, sums: list) -> np.ndarray:
    """The covariance with divisor n; entries are centred by a whole number, and exactly corrected for the rest."""
    d = len(sums)
    centre = np.array([s // n for s in sums], np.int64)
    upper = np.triu_indices(d)

    def run(batches):
        total = None
        for batch in batches:
            y = _scaled(batch.column(0)) - centre
            top = max(1, int(np.abs(y).max(initial=0)))
            step = max(1, (1 << 53) // (top * top))  # so many products add up exactly in a double
            for at in range(0, len(y), step):
                part = y[at : at + step]
                if top * top < 1 << 53:
                    part = part.astype(np.float64)
                product = (part.T @ part)[upper].astype(np.int64).astype(object)
                total = product if total is None else total + product
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), _whole(total)], ["i", "s"])

    parts = rows.select("embedding").mapInArrow(run, "i long, s decimal(38,0)")
    found = parts.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    out = np.empty((d, d))
    for (i, j), r in zip(zip(*upper), found):
        out[i, j] = out[j, i] = (n * int(r["s"]) - rest[i] * rest[j]) / (n * n)
    return out


# -- eigenvalues in a circle ----------------------------------------------------------


def count_below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie below `shift`: its inertia, by pivots of size one and two."""
    m = matrix - shift * np.eye(len(matrix))
    alpha = (1 + math.sqrt(17)) / 8
    below, k = 0, len(m)

    def swap(i, j):
        m[[i, j]] = m[[j, i]]
        m[:, [i, j]] = m[:, [j, i]]

    while k:
        j, single = k - 1, True
        column = np.abs(m[:j, j])
        r = int(column.argmax()) if j else 0
        if j and abs(m[j, j]) < alpha * column[r]:
            row = np.abs(m[r, :k])
            row[r] = 0
            widest = row.max()
            if abs(m[j, j]) * widest < alpha * column[r] ** 2:
                single = abs(m[r, r]) >= alpha * widest
                swap(r, j if single else j - 1)
        if single:
            pivot, column = m[j, j], m[:j, j].copy()
            below += pivot < 0
            if pivot:
                m[:j, :j] -= np.outer(column, column / pivot)
            k -= 1
        else:
            below += 1  # such a pivot has one eigenvalue of each sign
            columns = m[: k - 2, k - 2 : k].copy()
            m[: k - 2, : k - 2] -= columns @ np.linalg.solve(m[k - 2 : k, k - 2 : k], columns.T)
            k -= 2
    return int(below)


def circles(matrix: np.ndarray, wanted: int, floor: float) -> list[tuple[float, float, int]]:
    """(low, high, count) of intervals from the top down that hold the `wanted` greatest eigenvalues, or all above `floor`.

    An interval ends in gaps between eigenvalues that are wide beside it; eigenvalues too close to part share an interval.
    """
    d = len(matrix)
    top = float(np.abs(matrix).sum(1).max()) * 1.01  # no eigenvalue is greater (Gershgorin)
    tight = 1e-9 * top
    above: dict = {}  # shift to how many eigenvalues are greater

    def held(shift):
        if shift not in above:
            above[shift] = d - count_below(matrix, shift)
        return above[shift]

    def place(rank):
        """An interval of width `tight` at most that holds the eigenvalue of that rank, the greatest being 1."""
        low = max((s for s, m in above.items() if m >= rank), default=floor)
        high = min((s for s, m in above.items() if m < rank), default=top)
        while high - low > tight:
            middle = (low + high) / 2
            low, high = (middle, high) if held(middle) >= rank else (low, middle)
        return low, high

    all_held = held(floor)
    wanted = min(wanted, all_held)
    places = [place(rank) for rank in range(1, wanted + 1)]

    def gap(rank):
        """How far the eigenvalue of that rank is from the next."""
        while rank >= len(places):
            places.append(place(len(places) + 1) if len(places) < all_held else (0.0, floor))
        return places[rank - 1][0] - places[rank][1]

    out, before, over = [], 0, math.inf
    while before < wanted:
        first = places[before][1]
        ends = [r for r in range(before + 1, min(before + PER_CIRCLE, wanted) + 1) if gap(r) > max(tight, (first - places[r - 1][0]) / 4)]
        rank = ends[-1] if ends else before + 1
        while rank < all_held and gap(rank) <= tight:
            rank += 1
        under = gap(rank)
        out.append((places[rank - 1][0] - under / 2, first + min(under, over) / 2, rank - before))
        over, before = under, rank
    return out


def feast(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues in (low, high), falling, and their unit eigenvectors as columns."""
    d = len(matrix)
    width = min(d, count + count // 2 + 4)
    block = np.random.default_rng(seed).standard_normal((d, width))
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.exp(-0.5j * np.pi * (nodes - 1))
    size = np.abs(matrix).sum(1).max()
    error, values, vectors = math.inf, None, None
    for _ in range(ROUNDS):
        projected = np.zeros_like(block)
        for turn, weight in zip(angles, weights):
            shifted = (centre + radius * turn) * np.eye(d) - matrix
            projected += 0.5 * weight * (radius * turn * np.linalg.solve(shifted, block)).real
        basis, _ = np.linalg.qr(projected)
        ritz, inner = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ inner
        residual = np.abs(matrix @ block - block * ritz).max(0)
        inside = np.flatnonzero((ritz > low) & (ritz < high))
        inside = np.sort(inside[np.argsort(residual[inside], kind="stable")[:count]])[::-1]
        if len(inside) == count:
            now = residual[inside].max()
            settled = now <= 4 * EPS * size or (error <= 64 * EPS * size and now >= error / 2)
            if now < error:
                error, values, vectors = now, ritz[inside], block[:, inside]
            if settled:
                break
    if error > 1e-12 * size:
        raise ArithmeticError(f"the {count} eigenvalues in ({low}, {high}) did not settle: {error / size}")
    return values, vectors


def leading_pairs(spark, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` greatest eigenvalues, falling, and their eigenvectors; fewer if others are zero to rounding.

    A vector's entry of greatest magnitude, the first of equal ones, is positive.
    """
    d = len(matrix)
    size = float(np.abs(matrix).sum(1).max(initial=0))
    if size == 0:
        return np.empty(0), np.empty((d, 0))
    unit = matrix / size
    parts = circles(unit, wanted, 4 * d * EPS)

    def run(frames):
        for frame in frames:
            for number, low, high, count in zip(frame["number"], frame["low"], frame["high"], frame["count"]):
                values, vectors = feast(unit, low, high, count)
                yield pd.DataFrame({"number": number, "value": values, "vector": [list(v) for v in vectors.T]})

    if not parts:
        return np.empty(0), np.empty((d, 0))
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(parts)], "number int, low double, high double, count int")
    solved = table.repartition(len(parts), "number").mapInPandas(run, "number int, value double, vector array<double>")
    found = sorted(solved.collect(), key=lambda r: (r["number"], -r["value"]))[:wanted]
    vectors = np.array([r["vector"] for r in found]).T
    largest = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return np.array([r["value"] for r in found]) * size, vectors * np.sign(largest)


# -- the operator ---------------------------------------------------------------------


def fit(rows: DataFrame, wanted: int = 8) -> Whitening | None:
    """The covariance's leading components over the usable vectors; None without any."""
    n, sums = exact_sums(rows)
    if not n:
        return None
    matrix = covariance(rows, n, sums)
    values, vectors = leading_pairs(rows.sparkSession, matrix, wanted)
    return Whitening(n, sums, vectors, values, float(np.trace(matrix)))


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): each vector on the components, over the roots of their eigenvalues."""
    n, sums = model.n, np.array(model.sums, object)
    onto = model.components / np.sqrt(model.eigenvalues)
    small = n * 2 * LIMIT < 1 << 62
    plain = np.array(model.sums, np.int64) if small else None

    def run(batches):
        for batch in batches:
            x = _scaled(batch.column(1))
            away = n * x - plain if small else n * x.astype(object) - sums
            top = int(np.abs(away).max()) if away.size else 0
            squares = (away if top * top * x.shape[1] < 1 << 63 else away.astype(object)) ** 2
            whitened = (away.astype(np.float64) / n) @ onto
            ends = np.arange(len(x) + 1, dtype=np.int32) * onto.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _whole(squares.sum(1)), pa.ListArray.from_arrays(pa.array(ends), pa.array(whitened.reshape(-1)))],
                ["vec_id", "deviation", "whitened"],
            )

    kind = dict(rows.dtypes)["vec_id"]
    return rows.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of `whitened` (k entries a row) minus the identity."""
    at = [F.get("whitened", i) for i in range(k)]
    means = whitened.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)]).first()
    centred = [c - F.lit(means[i]) for i, c in enumerate(at)]
    entries = {(i, j): F.avg(centred[i] * centred[j]) - F.lit(1.0 if i == j else 0.0) for i in range(k) for j in range(i, k)}
    found = whitened.agg(*[F.abs(v).alias(f"e{i}_{j}") for (i, j), v in entries.items()]).first()
    return max(found)


def whiten(rows: DataFrame, wanted: int = 8) -> tuple[DataFrame, Whitening | None, float | None]:
    """(table, model, identity error): `table` has vec_id, deviation and whitened of every usable row.

    Rows are usable unless their vector is null or empty, holds a null or non-finite
    entry, or has another length than most. Each entry c becomes floor(1024 c) + 100000;
    `deviation` is the sum of the squares of n x - S, exact. `whitened` has up to `wanted` entries, fewer
    where the covariance has fewer eigenvalues above rounding: none for one vector or
    equal ones. Repeated rows count each and give a row each; a null id stays null.
    Components of equal eigenvalues are any basis of theirs. Reads `vec_id` and `embedding`
    only. Without a usable row the table is empty and the model None.
    """
    good = usable(rows)
    model = fit(good, wanted)
    if model is None:
        empty = good.limit(0).select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.col("embedding").alias("whitened"))
        return empty, None, None
    table = cut(project(good, model))
    k = len(model.eigenvalues)
    return table, model, identity_error(table, k) if k else None
