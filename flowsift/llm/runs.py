"""Periodic runs of words: stretches that repeat a period, found on suffix trees.

A run is a stretch of words with smallest period q (words q apart are equal) that
no neighbouring word extends. Every run of two or more periods holds a Lyndon root
of that length, in the order of the words or in its inverse: Bannai et al., "The
runs theorem", SIAM J. Comput. 46(5), 2017. The longest Lyndon word that starts at
a place ends before the next smaller suffix, so two passes over the ranks of the
suffixes propose every root, and each root is extended to both sides by longest
common extensions: on the suffix tree of the words to the right, on that of their
reversal to the left. The trees are built by Ukkonen's algorithm; an extension is
the depth of a lowest common ancestor, the least depth on the Euler tour between two
leaves, read in constant time from a table of minima over powers of two.

Trees are built only over the stretches that can hold a run of the wanted exponent:
in a run of period q every sequence of up to q words has occurred at most q words
before, and that many times in a row. `dense` finds them for all periods at once from
the distances to the last equal sequence; it leaves out nothing that holds a run. Such stretches
of many documents share a tree, with a word of its own between any two.

A task holds one Arrow batch and, besides that, some 1.5 kB per word of the longest
stretch or of `tree_words` words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import ODD, chunks, mix

SPACE_RUN = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Runs:
    exponent: int = 4  # a run is at least so many periods long; 2 or more
    least: int = 6  # and at least so many words
    tree_words: int = 1 << 14  # words that share a tree, unless one stretch is longer

    def shortest(self, period):
        return np.maximum(self.least, self.exponent * period)


# -- suffix trees ---------------------------------------------------------------------


class SuffixTree:
    """Suffix tree of a sequence of non-negative numbers, which gets an end mark of its own."""

    def __init__(self, codes: list):
        self.text = text = [*codes, -1]
        n = len(text)
        self.first, self.last, self.kids, self.suffix = [0], [0], [{}], [-1]
        first, last, kids, suffix, link = self.first, self.last, self.kids, self.suffix, [0]
        node = edge = length = pending = 0
        for i, c in enumerate(text):
            pending += 1
            waiting = -1  # the inner node made last, whose suffix link is not known yet
            while pending:
                if not length:
                    edge = i
                down = kids[node]
                head = text[edge]
                child = down.get(head)
                if child is None:
                    down[head] = len(first)
                    first.append(i)
                    last.append(n)
                    kids.append(None)
                    suffix.append(i - pending + 1)
                    link.append(0)
                    if waiting >= 0:
                        link[waiting] = node
                        waiting = -1
                else:
                    at = first[child]
                    span = last[child] - at
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    if text[at + length] == c:
                        if waiting >= 0:
                            link[waiting] = node
                        length += 1
                        break
                    middle = len(first)
                    down[head] = middle
                    first += (at, i)
                    last += (at + length, n)
                    kids += ({text[at + length]: child, c: middle + 1}, None)
                    suffix += (-1, i - pending + 1)
                    link += (0, 0)
                    first[child] = at + length
                    if waiting >= 0:
                        link[waiting] = middle
                    waiting = middle
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1

    def euler_tour(self, ordered: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(depths, place): the depth in words at each visit of an inner node, and the visit before each suffix's leaf.

        With `ordered`, children come in the order of their first word, the end mark first.
        """
        arranged = sorted if ordered else iter
        first, last, kids, suffix = self.first, self.last, self.kids, self.suffix
        place = [0] * len(self.text)
        depths, above, depth = [0], [], 0
        order = iter(arranged(kids[0].items()))
        while True:
            for _, child in order:
                below = kids[child]
                if below is None:
                    place[suffix[child]] = len(depths) - 1
                    depths.append(depth)
                    continue
                above.append((order, depth))
                depth += last[child] - first[child]
                depths.append(depth)
                order = iter(arranged(below.items()))
                break
            else:
                if not above:
                    return np.array(depths, np.int32), np.array(place, np.int64)
                order, depth = above.pop()
                depths.append(depth)


class Extensions:
    """Longest common prefixes of any two suffixes, each in constant time."""

    def __init__(self, tree: SuffixTree, ordered: bool = True):
        depths, self.place = tree.euler_tour(ordered)
        self.levels = [depths]
        width = 1
        while 2 * width <= len(depths):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def length(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.levels[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << int(k)) + 1])
        return out


def next_smaller(rank: list) -> np.ndarray:
    """For each place the next one of smaller rank; the length where there is none."""
    out = [len(rank)] * len(rank)
    open_places: list = []
    for i, r in enumerate(rank):
        while open_places and rank[open_places[-1]] > r:
            out[open_places.pop()] = i
        open_places.append(i)
    return np.array(out, np.int64)


def maximal_runs(codes: np.ndarray, cfg: Runs = Runs()) -> np.ndarray:
    """(start, length, period) of every run in a sequence of non-negative numbers, by start, then period.

    The end mark is a word like others here, the least in one order and the greatest in
    the inverse; it stands once, so no run holds it.
    """
    n = len(codes)
    if n < cfg.least:
        return np.empty((0, 3), np.int64)
    right = Extensions(SuffixTree(codes.tolist()))
    left = Extensions(SuffixTree(codes[::-1].tolist()), ordered=False)
    found = []
    for rank in (right.place, -right.place):
        start = np.arange(n)
        period = next_smaller(rank.tolist())[:n] - start
        fits = (cfg.shortest(period) <= n) & (start + period < n)
        start, period = start[fits], period[fits]
        after = right.length(start, start + period)
        before = np.zeros(len(start), np.int64)
        inner = np.flatnonzero(start > 0)
        # the word before place s is word n - s of the reversal
        before[inner] = left.length(n - start[inner], n - start[inner] - period[inner])
        length = before + period + after
        long = length >= cfg.shortest(period)
        found.append(np.stack([(start - before)[long], length[long], period[long]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


# -- where runs can be ----------------------------------------------------------------


def _reach(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances): where the code of a place stood before, and how many places before.

    `codes` are hashes of what stands at places `at`. Places are kept in their low bits,
    so that one sort of plain numbers brings equal ones together in order; hashes that
    agree in the rest only make distances shorter.
    """
    low = np.uint64((1 << int(at[-1]).bit_length()) - 1) if len(at) else np.uint64(0)
    keys = np.sort((codes & ~low) | at.astype(np.uint64))
    same = np.flatnonzero((keys[1:] ^ keys[:-1]) <= low)
    place = (keys & low).astype(np.int64)
    again, before = place[same + 1], place[same]
    order = np.argsort(again)
    return again[order], (again - before)[order]


def dense(codes: np.ndarray, doc: np.ndarray, cfg: Runs = Runs()) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of disjoint stretches, none across documents, that hold every run.

    `codes` are the words of all documents, `doc` the document of each, in order. A
    run of period q and length m has m - q - g + 1 places in a row at which a sequence
    of g <= q words begins that began at most q places before, too. A round looks
    for the periods above `low` and up to `high`, a quarter more.
    """
    n = len(codes)
    opens_doc = np.searchsorted(doc, np.arange(int(doc[-1]) + 2 if n else 1))
    longest = int(np.diff(opens_doc).max(initial=0))
    ends_doc = opens_doc[1:][doc] if n else doc
    cover = np.zeros(n + 1, np.int64)
    with np.errstate(over="ignore"):
        grams = mix(mix(codes.astype(np.uint64) + np.uint64(1)) + doc.astype(np.uint64) * np.uint64(ODD))
    width, low = 1, 0
    place, reach = _reach(grams, np.arange(n))
    while cfg.shortest(low + 1) <= longest:
        while 4 * width <= low + 1:
            for _ in range(2):  # sequences twice as long
                grams = mix(grams[: len(grams) - width] * np.uint64(ODD) + grams[width:])
                width *= 2
            at = np.arange(len(grams))
            at = at[at + width <= ends_doc[: len(grams)]]
            place, reach = _reach(grams[at], at)
        high = low + 1 + low // 4
        least = int(cfg.shortest(low + 1)) - (low + 1) - width + 1
        near = place[reach <= high]
        edges = np.flatnonzero(np.diff(near) != 1) + 1
        opens, closes = near[np.r_[0, edges]] if len(near) else near, near[np.r_[edges - 1, -1]] if len(near) else near
        keep = closes - opens + 1 >= max(1, least)
        opens, closes = opens[keep], closes[keep]
        np.add.at(cover, np.maximum(opens - high, opens_doc[doc[opens]]), 1)
        np.add.at(cover, np.minimum(closes + width, n), -1)
        low = high
    inside = np.cumsum(cover[:-1]) > 0
    edges = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    opens, closes = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    split = np.flatnonzero(np.diff(doc)) + 1
    cuts = split[inside[split] & inside[split - 1]]
    return np.sort(np.concatenate([opens, cuts])), np.sort(np.concatenate([closes, cuts]))


def document_runs(codes: np.ndarray, doc: np.ndarray, cfg: Runs = Runs()) -> tuple[np.ndarray, np.ndarray]:
    """(document, (start, length, period)) of all runs, starts counted within the document."""
    first, last = dense(codes, doc, cfg)
    owners, found = [np.empty(0, np.int64)], [np.empty((0, 3), np.int64)]
    opens = np.searchsorted(doc, np.arange(int(doc[-1]) + 2 if len(doc) else 1))
    i = 0
    while i < len(first):
        taken = np.cumsum(last[i:] - first[i:] + 1)
        j = i + max(1, int(np.searchsorted(taken, cfg.tree_words, "right")))
        parts, places, mark = [], [], int(codes.max()) + 1
        for k in range(i, j):
            parts += (codes[first[k] : last[k]], [mark + k - i])
            places += (np.arange(first[k], last[k]), [-1])
        joined, place = np.concatenate(parts[:-1]), np.concatenate(places[:-1])
        _, compact = np.unique(joined, return_inverse=True)
        runs = maximal_runs(compact, cfg)
        start = place[runs[:, 0]]
        owner = doc[start]
        owners.append(owner)
        found.append(np.column_stack([start - opens[owner], runs[:, 1], runs[:, 2]]))
        i = j
    return np.concatenate(owners), np.concatenate(found)


# -- the operator ---------------------------------------------------------------------


def find_runs(docs: DataFrame, cfg: Runs = Runs()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, runs, collapsed.

    `runs` lists (start, length, period) in words from 0, by start, then period.
    `collapsed` is the text without the words that any run holds after its first
    period, the others joined by one space. Words are runs of anything but ASCII white
    space and are compared byte by byte. Reads `doc_id` and `text` only, so other columns may have any
    names. A null or empty text, or one without words, has no runs and an empty
    `collapsed`. Repeated rows give repeated rows; a null id stays null. Whole texts are
    read, whatever their length. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(1)):
                raw, bounds = data.tobytes(), offsets.tolist()
                lists = [raw[a:b].split() for a, b in zip(bounds[:-1], bounds[1:])]
                counts = np.array([len(x) for x in lists], np.int64)
                words = [w for x in lists for w in x]
                numbers = {w: i for i, w in enumerate(set(words))}
                codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                doc = np.repeat(np.arange(len(lists)), counts)
                owner, runs = document_runs(codes, doc, cfg)
                kept = _collapsed(lists, owner, runs)
                ends = np.searchsorted(owner, np.arange(len(lists) + 1)).astype(np.int32)
                struct = pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(runs[:, k])) for k in range(3)], ["start", "length", "period"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(ends), struct),
                        pa.array([b" ".join(x) for x in kept], pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _collapsed(lists: list, owner: np.ndarray, runs: np.ndarray) -> list:
    out = list(lists)
    for d in np.unique(owner).tolist():
        mine = runs[owner == d]
        change = np.zeros(len(lists[d]) + 1, np.int64)
        np.add.at(change, mine[:, 0] + mine[:, 2], 1)
        np.add.at(change, mine[:, 0] + mine[:, 1], -1)
        stay = np.cumsum(change[:-1]) == 0
        out[d] = [w for w, s in zip(lists[d], stay.tolist()) if s]
    return out


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): `docs`, with the end of the texts of some ids made periodic.

    With h the CRC-32 of the decimal id and g = floor(h / 10): where 10 divides h, word
    i of n from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    Rows without a word or an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", SPACE_RUN), lambda w: w != "")

    def turned(w):
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int")
        later = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, later(i)))

    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(turned(w), " "))), 0)
    text = F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(made, "text")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))
