"""Benchmark decontamination: word pair seeds that no copy can avoid, then Smith-Waterman alignment.

Test items are worked on in blocks of bounded size. A seed is two words of an item in
their order, next to each other or with a word between them, and so in the document.
An alignment that reaches the threshold is charged for its edits, so a known number of
its places hold such a pair, wherever the edits are (`Decontaminate.sure`); an item
needs as seeds only one place more than an alignment may leave out. For each block a
first pass counts, over all documents, in how many of them each pair occurs, and the
rarest places are taken. Pairs that occur nowhere cost nothing and leave the count as
it is. The second pass aligns an item with the neighbourhood of each seed it shares
with a document, as wide as the threshold lets words be put in, if enough words
and pairs of the item are in it. The score is the best local alignment over words, as a share of what
the whole item aligned with itself would get, so insertions, deletions and replaced
words cost a little each instead of hiding the copy. Items too short for that are looked
for as whole sequences of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import ALNUM, Words, chunks, find_words, giving_back, mix, seeds, shingles, unspaced

WINDOW_WORDS = 1 << 17  # of the windows that one item is aligned with at once, or one window


@dataclass(frozen=True)
class Decontaminate:
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.5
    least_words: int = 8  # items with fewer are found only word by word
    exact_words: int = 3  # items with fewer are words of the language, and left out
    block_words: int = 500_000  # of the items worked on at once

    @property
    def cost(self) -> int:
        """What an edit takes from the score, at least."""
        return max(1, min(-self.mismatch, -self.gap))

    @property
    def reach(self) -> int:
        """Words from the first to the second of a pair, at most: matches further apart cost more than an alignment can spare at each of its words."""
        return int(self.match * (1 - self.threshold) / self.cost) + 1

    def sure(self, size: int) -> int:
        """In any alignment of an item of `size` words that reaches the threshold, so many matched words have the next within `reach`.

        Of m matches, m - 1 have a next one; where it is further off, `reach` edits or more
        lie between. What is left of the score is linear in m, so its ends give the least.
        """
        least, far = self.threshold * self.match * size, self.reach * self.cost
        ends = (int(np.ceil(self.threshold * size)), size)
        return max(1, int(np.ceil(min((least - self.match * m) / far + m - 1 for m in ends) - 1e-9)))

    def slack(self, size: int) -> int:
        """Words that can be put into a copy that reaches the threshold."""
        return int(self.match * size * (1 - self.threshold) / max(1, -self.gap))


def passage_words(data, offsets) -> Words:
    """Runs of ASCII letters and digits and of other characters; those of scripts without spaces one by one."""
    return find_words(data, offsets, ALNUM, breaks=unspaced(data))


class Items:
    """The words of a block of items, which of their pairs are seeds, and the sequences of short items.

    `ids` names the items to be aligned, then the short ones.
    """

    def __init__(self, ids, texts, cfg: Decontaminate):
        column = pa.array(texts, pa.large_string())
        self.ids, self.words, short = [], [], {}
        for first, last, data, offsets in chunks(column):
            found = passage_words(data, offsets)
            bounds = np.searchsorted(found.doc, np.arange(last - first + 1))
            for i, size in enumerate(np.diff(bounds).tolist()):
                own = found.hash[bounds[i] : bounds[i + 1]]
                if size >= cfg.least_words:
                    self.ids.append(ids[first + i])
                    self.words.append(own)
                elif size >= cfg.exact_words:
                    one = found._replace(doc=np.zeros(size, np.int64), hash=own)
                    short.setdefault(size, []).append((int(shingles(one, size, 1, False)[1][0]), ids[first + i]))
        self.short = {}  # words -> ascending fingerprints and the items they stand for
        for size, known in sorted(short.items()):
            known.sort()
            numbers = np.arange(len(self.ids), len(self.ids) + len(known))
            self.short[size] = np.array([h for h, _ in known], np.uint64), numbers
            self.ids += [i for _, i in known]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.needed = np.array([len(w) - cfg.sure(len(w)) for w in self.words], np.int64)  # places with seeds
        flat = np.concatenate(self.words) if self.words else np.empty(0, np.uint64)
        item, self.pair, at = _pairs(np.repeat(np.arange(len(self.words)), self.sizes), flat, cfg.reach)
        self.item, self.place = item, at - (np.cumsum(self.sizes) - self.sizes)[item]
        self._sort(np.argsort(self.pair, kind="stable"))
        self.kinds = np.unique(self.pair)

    def _sort(self, order) -> None:
        self.item, self.pair, self.place = self.item[order], self.pair[order], self.place[order]

    def keep_rare(self, df: np.ndarray) -> None:
        """Keep the pairs of each item's rarest places, as many as it needs; `df` is in the order of `kinds`."""
        often = df[np.searchsorted(self.kinds, self.pair)]
        width = int(self.sizes.max(initial=1))
        places, own = np.unique(self.item * width + self.place, return_inverse=True)
        total = np.zeros(len(places), np.int64)
        np.add.at(total, own, often)
        item = places // width
        order = np.lexsort((places, total, item))
        item = item[order]
        opens = np.flatnonzero(np.diff(item, prepend=-1))
        rank = np.arange(len(item)) - np.repeat(opens, np.diff(opens, append=len(item)))
        kept = np.zeros(len(places), bool)
        kept[order] = rank < self.needed[item]
        self._sort(np.flatnonzero(kept[own] & (often > 0)))


def _pairs(doc, hashes, reach):
    """(row, fingerprint, index of the first word) of all ordered pairs of words of a row at most `reach` apart."""
    first, second = seeds(2, 13)
    rows, pairs, at = [], [], []
    for apart in range(1, reach + 1):
        n = max(0, len(hashes) - apart)
        same = np.flatnonzero(doc[:n] == doc[apart:])
        rows.append(doc[same])
        pairs.append(mix(hashes[same] * first + hashes[same + apart] * second))
        at.append(same)
    return np.concatenate(rows), np.concatenate(pairs), np.concatenate(at)


def _sieve(kinds) -> np.ndarray:
    """Marks the low bits of all `kinds`, in a table sixteen times as long or longer."""
    maybe = np.zeros(1 << max(10, (16 * len(kinds)).bit_length()), bool)
    maybe[(kinds & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
    return maybe


def _known(kinds, values, sieve):
    """(index of a value, its first place in the sorted `kinds`) of all values among them."""
    some = np.flatnonzero(sieve[(values & np.uint64(len(sieve) - 1)).astype(np.int64)])
    at = np.searchsorted(kinds, values[some])
    good = at < len(kinds)
    good[good] = kinds[at[good]] == values[some[good]]
    return some[good], at[good]


def _within(values, table):
    """Which of `values` are in the sorted, not empty `table`."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _crowded(item, windows, cfg: Decontaminate):
    """Which windows hold as many words, and starts of pairs, of the item as every alignment that reaches the threshold has."""
    first, second = seeds(2, 13)
    enough = np.flatnonzero(_within(windows, np.unique(item)).sum(1) >= cfg.threshold * len(item))
    windows = windows[enough]
    own = np.unique(_pairs(np.zeros(len(item), np.int64), item, cfg.reach)[1])
    begins = np.zeros(windows.shape, bool)
    for apart in range(1, min(cfg.reach, windows.shape[1] - 1) + 1):
        begins[:, :-apart] |= _within(mix(windows[:, :-apart] * first + windows[:, apart:] * second), own)
    return enough[begins.sum(1) >= cfg.sure(len(item))]


def align(item: np.ndarray, windows: np.ndarray, cfg: Decontaminate) -> tuple[np.ndarray, np.ndarray]:
    """(score, end): best local alignment of `item` with each row of `windows`, and the window place after it.

    A row of the table is filled at once: along a row, the best gap so far is a running
    maximum of what came before, less the gaps in between.
    """
    steps = np.arange(windows.shape[1], dtype=np.int32) * cfg.gap
    above = np.zeros(windows.shape, np.int32)
    best, end = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int64)
    for word in item:
        cell = np.where(windows == word, np.int32(cfg.match), np.int32(cfg.mismatch))
        cell[:, 1:] += above[:, :-1]
        np.maximum(cell, above + cfg.gap, out=cell)
        np.maximum(cell, 0, out=cell)
        np.maximum(np.maximum.accumulate(cell - steps, axis=1) + steps, cell, out=cell)
        above = cell
        top = above.argmax(1)
        value = above[np.arange(len(windows)), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
    return best, end


def _verbatim(words: Words, rows: int, items: Items, sieves: dict, best: dict) -> None:
    """Adds the first place of every short item in each text to `best`."""
    for size, (known, numbers) in items.short.items():
        doc, found = shingles(words, size, rows, False)
        hit, low = _known(known, found, sieves[size])
        # shingles are in text order: those of a row follow its own first one
        begins = np.searchsorted(doc, np.arange(rows))
        for h, at in zip(hit.tolist(), low.tolist()):
            row, value = int(doc[h]), known[at]
            while at < len(known) and known[at] == value:
                place = h - int(begins[row])
                best.setdefault((row, int(numbers[at])), (1.0, place, place + size))
                at += 1


def _sieves(items: Items):
    """The sieve of the seeds, and one for each size of short items."""
    return _sieve(items.pair), {size: _sieve(known) for size, (known, _) in items.short.items()}


def _matches(column: pa.Array, items: Items, cfg: Decontaminate, made=None):
    """(first row, last row, row, item, score, start word, end word) for runs of rows; `made` are the items' sieves, if there already."""
    sieve, sieves = made or _sieves(items)
    for first, last, data, offsets in chunks(column):
        words = passage_words(data, offsets)
        doc, pairs, at = _pairs(words.doc, words.hash, cfg.reach)
        hit, low = _known(items.pair, pairs, sieve)
        many = np.searchsorted(items.pair, pairs[hit], "right") - low
        seed = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, item = np.repeat(doc[hit], many), items.item[seed]
        sizes = items.sizes
        opens = np.searchsorted(words.doc, np.arange(last - first + 1))
        begin = np.repeat(at[hit], many) - opens[row] - items.place[seed]  # where the item would start in the text
        stripe = np.floor_divide(begin, sizes[item]) + 1 if len(item) else begin
        lanes_of = int(stripe.max(initial=0)) + 1
        keys = np.unique((item * (last - first) + row) * lanes_of + stripe)
        keys = np.stack([keys // lanes_of // (last - first), keys // lanes_of % (last - first), keys % lanes_of - 1], axis=1)
        found = []
        for i in np.unique(keys[:, 0]):
            own = keys[keys[:, 0] == i]
            size = int(sizes[i])
            pad = cfg.slack(size)
            step = max(1, min(512, WINDOW_WORDS // (2 * size + 2 * pad)))
            for part in range(0, len(own), step):
                rows, lanes = own[part : part + step, 1], own[part : part + step, 2]
                start = lanes * size - pad
                place = start[:, None] + np.arange(2 * size + 2 * pad)
                length = (opens[rows + 1] - opens[rows])[:, None]
                inside = (place >= 0) & (place < length)
                index = np.clip(opens[rows][:, None] + place, 0, max(len(words.hash) - 1, 0))
                windows = np.where(inside, words.hash[index], np.uint64(0))
                enough = _crowded(items.words[i], windows, cfg)
                if not len(enough):
                    continue
                rows, start, windows = rows[enough], start[enough], windows[enough]
                score, end = align(items.words[i], windows, cfg)
                good = np.flatnonzero(score >= cfg.threshold * cfg.match * size)
                if len(good):
                    _, back = align(items.words[i][::-1], windows[good][:, ::-1], cfg)
                    begins = windows.shape[1] - back
                    for g, b in zip(good, begins):
                        found.append((rows[g], i, score[g] / (cfg.match * size), max(0, start[g] + b), start[g] + end[g]))
        best: dict = {}
        for r, i, s, b, e in found:
            old = best.get((r, i))
            if old is None or (s, -b) > (old[0], -old[1]):
                best[r, i] = (s, b, e)
        _verbatim(words, last - first, items, sieves, best)
        yield first, last, best


def blocks(spark, benchmark: DataFrame, docs: DataFrame, cfg: Decontaminate):
    """The benchmark as `Items` with their seeds, a block at a time."""
    ready = []
    size = 0
    texts = benchmark.filter("text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text")
    for row in texts.toLocalIterator():
        ready.append(row)
        size += len(row.text) // 5 + 1
        if size >= cfg.block_words:
            yield _block(ready, docs, cfg)
            ready, size = [], 0
    if ready:
        yield _block(ready, docs, cfg)


def _block(rows, docs: DataFrame, cfg: Decontaminate) -> Items:
    items = Items([r.item_id for r in rows], [r.text for r in rows], cfg)
    kinds = items.kinds

    def run(batches):
        sieve = _sieve(kinds)
        total = np.zeros(len(kinds), np.int64)
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(0)):
                words = passage_words(data, offsets)
                doc, pairs, _ = _pairs(words.doc, words.hash, cfg.reach)
                some, at = _known(kinds, pairs, sieve)
                once = np.unique(doc[some] * len(kinds) + at)
                total += np.bincount(once % max(len(kinds), 1), minlength=len(kinds))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["kind", "df"])

    df = np.zeros(len(kinds), np.int64)
    counted = docs.select("text").mapInArrow(giving_back(run), "kind long, df long").groupBy("kind").agg(F.sum("df").alias("df"))
    for row in counted.toLocalIterator():
        df[row["kind"]] = row["df"]
    items.keep_rare(df)
    return items


def contaminated(docs: DataFrame, benchmark: DataFrame, cfg: Decontaminate = Decontaminate()) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): copies of items in documents, the best one per pair.

    Words are runs of ASCII letters and digits and of all non-ASCII characters, without
    regard to the case of A-Z, and single characters of Chinese, Japanese, Thai, Lao, Burmese
    and Khmer; start_word and end_word (exclusive) count them from 0. Items with fewer than
    `least_words` words are found where all their words stand in a row.
    Reads `doc_id` and `text` of `docs`, `item_id` and `text` of `benchmark`; other
    columns may have any names. Null and empty texts match nothing, nor do items with
    fewer than `exact_words` words. Equal rows are reported once; several items with
    one text are each reported; of equally good places the first counts. Empty tables
    give an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    out = None
    for items in blocks(spark, benchmark, docs, cfg):

        def run(batches, items=items):
            made = _sieves(items)
            for batch in batches:
                for first, _, best in _matches(batch.column(1), items, cfg, made):
                    if not best:
                        continue
                    rows = pa.array([first + int(r) for r, _ in best])
                    named = pa.array([items.ids[i] for _, i in best], pa.int64())
                    values = list(best.values())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows), named, pa.array([float(v[0]) for v in values]),
                            pa.array([int(v[1]) for v in values]), pa.array([int(v[2]) for v in values]),
                        ],
                        ["doc_id", "item_id", "score", "start_word", "end_word"],
                    )

        part = docs.select("doc_id", "text").mapInArrow(giving_back(run), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def keep_clean(docs: DataFrame, benchmark: DataFrame, cfg: Decontaminate = Decontaminate()) -> DataFrame:
    """The rows of `docs` in whose text no item is found, with all their columns.

    Null and empty texts stay, repeated rows alike; without items all rows do.
    """
    text = docs.columns.index("text")
    out = docs
    for items in blocks(docs.sparkSession, benchmark, docs, cfg):

        def run(batches, items=items):
            made = _sieves(items)
            for batch in batches:
                for first, last, best in _matches(batch.column(text), items, cfg, made):
                    clean = np.ones(last - first, bool)
                    clean[[r for r, _ in best]] = False
                    yield batch.slice(first, last - first).filter(pa.array(clean))

        out = out.mapInArrow(giving_back(run), docs.schema)
    return out
