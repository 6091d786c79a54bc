"""Numpy helpers that work on one bounded block of vectors inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21  # distances held at once by one task


def matrix(table: pa.Table, name: str = "vec") -> np.ndarray:
    """An array column as rows × coordinates."""
    column = table.column(name).combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def floats(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(float)


def vectors(rows: np.ndarray) -> pa.Array:
    """Rows × coordinates as an array column."""
    rows = np.ascontiguousarray(rows, dtype=float)
    step = rows.shape[1] if rows.ndim == 2 else 0
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * step
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def constant(table: pa.Table, names, length: int) -> dict:
    """Key columns of a group, repeated for `length` output rows."""
    return {k: pa.repeat(table.column(k)[0], length) for k in names}


def sq_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by direct differences, one coordinate at a time.

    Differences keep exact zeros and give the same value in both directions,
    whichever block a vector is in; coordinates that are 0 throughout are skipped.
    """
    out = np.zeros((len(a), len(b)))
    if not out.size:
        return out
    for j in np.flatnonzero(a.any(axis=0) | b.any(axis=0)):
        diff = a[:, j, None] - b[None, :, j]
        diff *= diff
        out += diff
    return out


def row_chunks(rows: int, columns: int):
    """Slices over `rows` such that one slice × `columns` stays within CHUNK."""
    step = max(1, CHUNK // max(1, columns))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def nearest_in_block(a, b, own, k, wa=None, wb=None):
    """The k nearest rows of `b` for each row of `a`: (positions, values).

    `own` is the position in `b` of each row of `a` itself, or -1. With weights
    the value is the Ward merge cost, otherwise the distance. Missing neighbours
    have an infinite value. Rows of `b` come in id order, which settles ties.
    """
    k = min(k, len(b))
    positions = np.zeros((len(a), k), dtype=int)
    values = np.full((len(a), k), np.inf)
    for rows in row_chunks(len(a), len(b)):
        d = sq_distances(a[rows], b)
        if wa is not None:
            pair = wa[rows, None]
            d *= pair * wb[None, :] / (pair + wb[None, :])
        mine = own[rows]
        inside = np.flatnonzero(mine >= 0)
        d[inside, mine[inside]] = np.inf
        best = d.argmin(axis=1)[:, None] if k == 1 else d.argsort(axis=1, kind="stable")[:, :k]
        positions[rows] = best
        values[rows] = np.take_along_axis(d, best, axis=1)
    return positions, values if wa is not None else np.sqrt(values)


def first_copies(rows: np.ndarray, most: int) -> np.ndarray:
    """Positions of at most `most` rows of each run of equal ones, the first in order."""
    seen: dict = {}
    kept = []
    for i, row in enumerate(rows):
        key = row.tobytes()
        have = seen.get(key, 0)
        if have < most:
            kept.append(i)
            seen[key] = have + 1
    return np.array(kept, dtype=int)


def _merge_best(values, positions, rows, d, at, order):
    """Puts the pairs (rows, at) with squared distances `d` into the best of each row; the rows that were touched."""
    k = values.shape[1]
    touched = np.unique(rows)
    have = np.isfinite(values[touched])
    row = np.concatenate([rows, np.repeat(touched, k)[have.ravel()]])
    dist = np.concatenate([d, values[touched][have]])
    pos = np.concatenate([at, positions[touched][have]])
    by = np.lexsort((order[pos], dist, row))
    row, dist, pos = row[by], dist[by], pos[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    values[touched] = np.inf
    values[row[kept], place[kept]] = dist[kept]
    positions[row[kept], place[kept]] = pos[kept]
    return touched


def nearest_by_products(a, b, own, k, bound, order, edges):
    """As `nearest_in_block`, for blocks of many thousand rows: (positions, distances), exact.

    Rows of `b` come in parts that begin and end at `edges`; `order` settles ties. Nothing beyond
    `bound`, one distance per row of `a`, is looked for, and parts that are farther off are skipped. Matrix products
    propose pairs, with room for their rounding, and direct differences decide, so the distances are those
    of `sq_distances` bit for bit. Rows with other than finite numbers have no neighbours.
    """
    positions = np.zeros((len(a), k), dtype=int)
    values = np.full((len(a), k), np.inf)
    if not len(a) or not len(b):
        return positions, values
    limit = np.where(np.isfinite(bound), bound, np.inf) ** 2 * (1 + 1e-9)
    fine = np.isfinite(b).all(axis=1)
    shift = b[fine].mean(axis=0) if fine.any() else np.zeros(b.shape[1])
    x, y = a - shift, np.where(fine[:, None], b - shift, 0.0)
    sane = np.isfinite(x).all(axis=1)
    x[~sane] = 0.0
    xx, yy = (x**2).sum(axis=1), (y**2).sum(axis=1)
    top = xx.max(initial=0) + yy.max(initial=0)
    unsure = (b.shape[1] + 8) * top  # times the unit of rounding
    near = limit[np.isfinite(limit)]
    single = len(near) > 0 and top < 1e30 and unsure * 2.0**-22 <= 0.02 * np.median(near)
    kind, unsure = (np.float32, unsure * 2.0**-22) if single else (np.float64, unsure * 2.0**-51)
    x, y = x.astype(kind), (-2 * y).astype(kind)
    yy = np.where(fine, yy, np.inf).astype(kind)
    parts = list(zip(edges[:-1], edges[1:]))
    centres = np.stack([b[s:e][fine[s:e]].mean(axis=0) if fine[s:e].any() else np.full(b.shape[1], np.inf) for s, e in parts])
    with np.errstate(invalid="ignore", over="ignore"):
        radius = np.array([np.sqrt(sq_distances(c[None], b[s:e][fine[s:e]]).max(initial=0)) for c, (s, e) in zip(centres, parts)])
    step = max(64, CHUNK // max(e - s for s, e in parts))
    for start in range(0, len(a), step):
        here = np.arange(start, min(len(a), start + step))
        with np.errstate(invalid="ignore", over="ignore"):
            apart = np.sqrt(sq_distances(a[here], centres))
            low = np.maximum(apart - radius - 1e-9 * (apart + radius), 0.0) ** 2
        for j in np.argsort(low.mean(axis=0), kind="stable"):
            first, last = parts[j]
            rows = here[sane[here] & (low[:, j] <= limit[here])]
            if not len(rows):
                continue
            score = x[rows] @ y[first:last].T
            score += yy[first:last]
            inside = np.flatnonzero((own[rows] >= first) & (own[rows] < last))
            score[inside, own[rows[inside]] - first] = np.inf
            most = np.minimum(limit[rows] - xx[rows] + unsure, np.finfo(kind).max).astype(kind)  # below infinite scores
            hit = score <= most[:, None]
            if last - first > k and np.count_nonzero(hit) > 4 * k * len(rows):
                kth = np.partition(score, k - 1, axis=1)[:, k - 1] + kind(2 * unsure)
                hit = score <= np.minimum(most, kth)[:, None]
            pair = np.flatnonzero(hit)
            i, at = rows[pair // (last - first)], pair % (last - first) + first
            for some in row_chunks(len(i), b.shape[1]):
                diff = a[i[some]] - b[at[some]]
                diff *= diff
                d = np.ascontiguousarray(diff.T).sum(axis=0)  # one coordinate after the other
                kept = d <= limit[i[some]]
                if kept.any():
                    touched = _merge_best(values, positions, i[some][kept], d[kept], at[some][kept], order)
                    limit[touched] = np.minimum(limit[touched], values[touched, k - 1])
    return positions, np.sqrt(values)


def components_in_block(x, eps, digits=None):
    """Component number per row of the graph joining rows at most `eps` apart.

    Rows are visited breadth first, so each row meets the unvisited ones once
    and no edge is kept. A component is numbered by its first row.
    """
    label = np.full(len(x), -1)
    rest = np.arange(len(x))
    while len(rest):
        start, rest = rest[0], rest[1:]
        label[start] = start
        frontier = np.array([start])
        while len(frontier) and len(rest):
            hit = np.zeros(len(rest), dtype=bool)
            for rows in row_chunks(len(frontier), len(rest)):
                hit |= (distances(x[frontier[rows]], x[rest], digits) <= eps).any(axis=0)
            frontier, rest = rest[hit], rest[~hit]
            label[frontier] = start
    return label


def distances(a, b, digits=None):
    d = np.sqrt(sq_distances(a, b))
    return d if digits is None else np.round(d, digits)


def linked_labels(a, la, b, lb, eps, digits=None):
    """Pairs of labels joined by rows at most `eps` apart, without cycles."""
    parent: dict = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    kept = []
    for rows in row_chunks(len(a), len(b)):
        i, j = np.nonzero(distances(a[rows], b, digits) <= eps)
        codes = np.unique(np.stack([la[rows][i], lb[j]]), axis=1).T if len(i) else []
        for p, q in codes:
            rp, rq = root(p), root(q)
            if rp != rq:
                parent[max(rp, rq)] = min(rp, rq)
                kept.append((p, q))
    return kept


def hash_uniform(seed: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from per-row 64-bit hashes and a step number."""
    with np.errstate(over="ignore"):
        z = seed.astype(np.int64).view(np.uint64) + np.uint64(step + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def seed_centres(x, w, seed, count):
    """Positions of up to `count` rows, picked with chance by weight × squared distance.

    Each pick is the largest of log(u) / mass, which is a weighted draw without
    any running state; the first n picks are the seeding for n centres. Fewer
    are returned when every row already is a centre.
    """
    picks: list[int] = []
    mass = w
    near = np.full(len(x), np.inf)
    for step in range(count):
        with np.errstate(divide="ignore"):
            key = np.where(mass > 0, np.log(hash_uniform(seed, step)) / mass, -np.inf)
        pick = int(key.argmax())
        if not mass[pick] > 0:
            break
        picks.append(pick)
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(axis=1))
        mass = w * near
    return picks


def closest_centres(x, centres):
    """Position of the closest centre for each row, and the squared distance; the first of equally close ones.

    Products propose the closest; where two are as close as their rounding could
    tell, direct differences decide. So a row's answer does not depend on the rows beside it.
    """
    own = (centres**2).sum(axis=1)
    score = own[None, :] - 2 * (x @ centres.T)
    at = score.argmin(axis=1)
    if len(centres) > 1:
        least = score[np.arange(len(x)), at]
        unsure = 1e-11 * ((x**2).sum(axis=1) + own.max())
        close = np.flatnonzero((score <= (least + unsure)[:, None]).sum(axis=1) > 1)
        for rows in row_chunks(len(close), len(centres)):
            at[close[rows]] = sq_distances(x[close[rows]], centres).argmin(axis=1)
    return at, ((x - centres[at]) ** 2).sum(axis=1)


def limb_bits(total: float) -> int:
    """Bits a limb may have so that limbs times weights adding up to `total` sum exactly in a double."""
    return max(8, 52 - int(np.ceil(np.log2(max(total, 1.0)))))


def limbs(values: np.ndarray, unit: float, bits: int) -> np.ndarray:
    """Numbers up to `unit`, a power of two, as two whole numbers each: the high limbs, then the low ones.

    Sums of whole numbers are the same in any order, which sums of fractions are not.
    """
    scaled = values / unit * 2.0**bits
    high = np.rint(scaled)
    return np.hstack([high, np.rint((scaled - high) * 2.0**bits)])


def from_limbs(sums: np.ndarray, unit: float, bits: int) -> np.ndarray:
    high, low = np.split(sums, 2, axis=-1)
    return (high + low / 2.0**bits) / 2.0**bits * unit


def power_above(top: float) -> float:
    """The smallest power of two that is not below `top`; 1 for 0."""
    return 2.0 ** np.ceil(np.log2(top)) if top > 0 else 1.0


def centre_sums(parts, w, at, count):
    """Per centre: weighted sum of its rows' limbs, and their weight."""
    share = np.zeros((len(parts), count))
    share[np.arange(len(parts)), at] = w
    return share.T @ parts, share.sum(axis=0)


def cost_limbs(w, d, at, count, unit, bits):
    """Per centre: weighted sum of squared distances, as two limbs."""
    parts = limbs(d[:, None], unit, bits)
    return np.stack([np.bincount(at, weights=w * parts[:, j], minlength=count) for j in (0, 1)], axis=1)


def merge_closest(x, w, height):
    """Full Ward tree of one block: (absorbed, survivor, height) in merge order.

    Clusters that are each other's nearest merge together, round by round,
    which gives the same tree as merging one closest pair at a time. The
    survivor is the earlier row; equal costs prefer earlier rows.
    """
    x, w, height = x.copy(), w.copy(), height.copy()
    n = len(x)
    cost = sq_distances(x, x) * (w[:, None] * w[None, :] / (w[:, None] + w[None, :]))
    np.fill_diagonal(cost, np.inf)
    live = np.ones(n, dtype=bool)
    merges = []
    while live.sum() > 1:
        near = cost.argmin(axis=1)
        rows = np.flatnonzero(live)
        pairs = [(a, near[a]) for a in rows if a < near[a] and near[near[a]] == a]
        for a, b in sorted(pairs, key=lambda p: (cost[p], p)):
            height[a] = max(cost[a, b], height[a], height[b])
            merges.append((b, a, height[a]))
            x[a] = (w[a] * x[a] + w[b] * x[b]) / (w[a] + w[b])
            w[a] += w[b]
            live[b] = False
        gone = [b for _, b in pairs]
        cost[gone, :] = cost[:, gone] = np.inf
        kept = np.flatnonzero(live)
        changed = np.array([a for a, _ in pairs])
        fresh = sq_distances(x[changed], x[kept]) * (
            w[changed, None] * w[None, kept] / (w[changed, None] + w[None, kept])
        )
        fresh[changed[:, None] == kept[None, :]] = np.inf
        cost[np.ix_(changed, kept)] = fresh
        cost[np.ix_(kept, changed)] = fresh.T
    return merges
