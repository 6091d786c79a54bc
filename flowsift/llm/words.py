"""Words of whole Arrow columns and their 64-bit fingerprints, in numpy.

A text column is worked on in its UTF-8 buffer, half a megabyte at a time, so a
task's memory does not depend on how many rows a batch holds; a single text is
never cut. Some places hold 60 bytes for each byte of text.
"""

from __future__ import annotations

import ctypes
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
ODD = 0x9E3779B97F4A7C15

BYTES = np.arange(256)
SPACE = (BYTES == 0x20) | ((BYTES >= 0x09) & (BYTES <= 0x0D))
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
ALNUM = ((BYTES >= 48) & (BYTES <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (BYTES >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    """`n` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.uint64(seed) * np.uint64(ODD) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(ODD)) | np.uint64(1)


def byte_values(fold: bool = True) -> np.ndarray:
    """A random 64-bit value per byte; with `fold`, A-Z have those of a-z."""
    values = seeds(256, 7)
    return values[LOWER] if fold else values


class Words(NamedTuple):
    """One entry per word, in text order."""

    doc: np.ndarray  # row within the chunk
    start: np.ndarray  # byte offset within the chunk
    size: np.ndarray  # bytes
    hash: np.ndarray
    prefixes: list  # a hash array per wanted prefix length


def chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first row, last row, bytes, offsets) for runs of rows of at most `limit` bytes, or one row.

    Null texts have no bytes.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        own = offsets[first : last + 1]
        yield first, last, data[own[0] : own[-1]], own - own[0]
        first = last


def give_back() -> None:
    """Hand memory that is free in this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run):
    """`run`, a function for mapInArrow, with what it took handed back at the end of a task.

    Python workers live on and serve later stages, beside which they would go on holding it.
    """

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where a character of a script that is written without spaces begins or has just ended.

    Those are Chinese characters, kana, Thai, Lao, Burmese and Khmer, told by the first bytes
    of their UTF-8 form. Such characters are words of their own where these places are breaks.
    """
    out = np.zeros(len(data), bool)
    if not len(data) or data.max() < 0xE0:
        return out
    second = np.append(data[1:], np.uint8(0))
    three = (data >= 0xE3) & (data <= 0xE9)
    three |= (data == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
    three |= (data == 0xE1) & (((second >= 0x80) & (second <= 0x82)) | (second == 0x9E) | (second == 0x9F))
    four = (data == 0xF0) & (second >= 0xA0) & (second <= 0xB3)
    for leads, size in ((three, 3), (four, 4)):
        at = np.flatnonzero(leads)
        out[at] = True
        after = at + size
        out[after[after < len(data)]] = True
    return out


def find_words(data, offsets, inside=~SPACE, values=None, prefixes=(), breaks=None) -> Words:
    """Maximal runs of the bytes marked in `inside`; a word never crosses two texts, nor a place marked in `breaks`."""
    values = byte_values() if values is None else values
    within = inside[data]
    first = within.copy()
    first[1:] &= ~within[:-1]
    if breaks is not None:
        first |= within & breaks
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = within[edges]
    at = np.flatnonzero(within)
    if not len(at):
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.empty(0, np.uint64), [np.empty(0, np.uint64) for _ in prefixes])
    opens = np.flatnonzero(first[at])
    size = np.diff(opens, append=len(at))
    rank = np.arange(len(at)) - np.repeat(opens, size)
    power = np.full(int(size.max()), ODD, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    terms = values[data[at]] * power[rank]
    start = at[opens]
    doc = np.searchsorted(offsets, start, side="right") - 1
    whole = mix(np.add.reduceat(terms, opens))
    heads = [mix(np.add.reduceat(np.where(rank < k, terms, np.uint64(0)), opens)) for k in prefixes]
    return Words(doc, start, size, whole, heads)


def shingles(words: Words, width: int, rows: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of every run of `width` words within a text, repeats included.

    With `short`, a text of fewer words gives its whole sequence as one.
    """
    factors = seeds(width, 11)
    n = len(words.hash)
    count = np.bincount(words.doc, minlength=rows)
    if n >= width:
        total = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            total += words.hash[j : n - width + 1 + j] * factors[j]
        same = words.doc[: n - width + 1] == words.doc[width - 1 :]
        doc, found = words.doc[: n - width + 1][same], mix(total[same])
    else:
        doc, found = np.empty(0, np.int64), np.empty(0, np.uint64)
    if not short or not n:
        return doc, found
    few = (count[words.doc] < width) & (count[words.doc] > 0)
    if not few.any():
        return doc, found
    opens = np.flatnonzero(np.diff(words.doc, prepend=-1) != 0)
    place = np.arange(n) - np.repeat(opens, np.diff(opens, append=n))
    own, at = words.doc[few], place[few]
    sums = np.add.reduceat(words.hash[few] * factors[at], np.flatnonzero(np.diff(own, prepend=-1) != 0))
    rows_few = own[np.flatnonzero(np.diff(own, prepend=-1) != 0)]
    sums = mix(sums + count[rows_few].astype(np.uint64) * np.uint64(ODD))
    doc, found = np.concatenate([doc, rows_few]), np.concatenate([found, sums])
    order = np.argsort(doc, kind="stable")
    return doc[order], found[order]


def distinct(doc: np.ndarray, values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): each row's distinct values, sorted; `doc` is in order."""
    bounds = np.searchsorted(doc, np.arange(rows + 1))
    sets = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else np.empty(0, values.dtype)), offsets
