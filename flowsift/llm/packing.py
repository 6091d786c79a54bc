"""Packing token sequences: cutting stock by column generation.

Documents are cut into pieces of at most one sequence. The histogram of piece
lengths, in steps of `step` tokens, is all the planner needs: a linear program
chooses how often each pattern of lengths is used, and dynamic programming for the
knapsack finds the pattern that would improve it most, until none does. Patterns are
used a whole number of times; what rounding leaves is packed largest first. Pieces
are ranked within their length class, and each rank has its place in one sequence of
one pattern. The histogram has as many entries as there are classes, whatever the
number of documents; nothing else comes to the driver.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from ..session import cut
from .tables import spread_ranks
from .words import chunks, giving_back


@dataclass(frozen=True)
class Packing:
    tokens: int = 4096  # of a sequence
    step: int = 16  # lengths are rounded up to multiples of this
    end_id: int = 2  # closes every document
    gap: float = 1e-3  # the linear program may stop this close to its bound
    most_columns: int = 4000  # or after so many patterns
    cached_words: int = 400_000  # per task


# Characters for which splitting off words one by one gives the tokenizer's own ids:
# all are unchanged by NFC, have one lower-case form and the same class everywhere.
PLAIN = "\t\n\r" + "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250)]))
LETTERS = "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == "L")
NUMBERS = "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == "N")


class WordTokenizer:
    """A word-wise BPE tokenizer that remembers the ids of words.

    `encode` gives what the tokenizer gives for the whole text. Texts with characters
    outside `PLAIN`, or with what may be a special token, go to the tokenizer whole.
    """

    def __init__(self, definition: str, most: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.other = re.compile("[^" + re.escape(PLAIN) + "]|<\\|")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^ \t\n\r{LETTERS}{NUMBERS}]+")
        self.signs = byte_signs()
        self.known: dict = {}
        self.most = most

    def code(self, word: str) -> bytes:
        """The ids of one word, by the tokenizer's merges alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.other.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words.findall(text.lower())
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > self.most:
                known.clear()
                new = set(words)
            for word in new:
                known[word] = self.code(word)
        return b"".join(map(known.__getitem__, words))


def byte_signs() -> dict:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    signs, other = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            signs[byte] = chr(byte)
        else:
            signs[byte] = chr(other)
            other += 1
    return signs


def token_pieces(docs: DataFrame, definition: str, cfg: Packing = Packing(), kind: str = "<u4") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32, ids): every document's ids, cut every `tokens` ids.

    `definition` is the tokenizer's JSON. A null text counts as empty; every document
    ends with `end_id`, so each has a piece. `ids` are of type `kind`; the check sum is
    always that of little-endian unsigned 32-bit ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    end = np.array([cfg.end_id], "<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = WordTokenizer(shared.value, cfg.cached_words)
        width = 4 * cfg.tokens
        for batch in batches:
            for first, last, _, _ in chunks(batch.column(1)):
                doc, start, length, total, sums, ids = [], [], [], [], [], []
                for row, text in enumerate(batch.column(1).slice(first, last - first).to_pylist(), first):
                    coded = tokenizer.encode(text or "") + end
                    parts = [coded[i : i + width] for i in range(0, len(coded), width)]
                    ids += parts if kind == "<u4" else [np.frombuffer(p, "<u4").astype(kind).tobytes() for p in parts]
                    sums += [zlib.crc32(p) for p in parts]
                    length += [len(p) // 4 for p in parts]
                    start += range(0, len(coded) // 4, cfg.tokens)
                    doc += [row] * len(parts)
                    total += [len(coded) // 4] * len(parts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), *(pa.array(a, pa.int64()) for a in (start, length, total, sums)), pa.array(ids, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"],
                )

    schema = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(giving_back(run), schema)


def narrow_kind(definition: str) -> str:
    """The smaller of two number types that holds every id of a tokenizer."""
    parts = json.loads(definition)
    ids = [*parts["model"]["vocab"].values(), *(t["id"] for t in parts.get("added_tokens") or [])]
    return "<u2" if max(ids, default=0) < 1 << 16 else "<u4"


def widened(packed: DataFrame, kind: str) -> DataFrame:
    """`packed` with its ids of type `kind` as unsigned 32-bit ones."""
    if kind == "<u4":
        return packed

    # two more bytes after each id, in plain functions: rows of many kB need no way through Python workers
    wide = F.unhex(F.regexp_replace(F.hex("ids"), "(.{4})", "$10000"))
    return packed.withColumn("ids", wide)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest total price that fits: an unbounded knapsack by dynamic programming."""
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, "right")
        value[room] = value[room - 1]
        if fits:
            gains = value[room - sizes[:fits]] + prices[:fits]
            top = int(gains.argmax())
            if gains[top] > value[room] + 1e-12:
                value[room], taken[room] = gains[top], top
    count, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            count[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return value[capacity], count


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int, cfg: Packing) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): patterns that together take exactly `demand` pieces of each of the ascending `sizes`."""
    if not len(sizes):
        return []
    basis = np.diag((capacity // sizes).astype(np.float64))
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(cfg.most_columns):
        level = inverse @ demand
        price, column = best_pattern(sizes, np.maximum(inverse.sum(0), 0), capacity)
        if price <= 1 + cfg.gap:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        inverse[out] /= step[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(step[others], inverse[out])
    left = demand.astype(np.int64).copy()
    used = []
    level = inverse @ demand
    for j in np.argsort(-level, kind="stable"):
        pattern = basis[:, j].astype(np.int64)
        held = pattern > 0
        times = min(int(level[j] + 1e-6), int((left[held] // pattern[held]).min())) if held.any() else 0
        if times > 0:
            used.append((pattern, times))
            left -= pattern * times
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(int(left[k]), room // int(sizes[k]))
            room -= int(pattern[k] * sizes[k])
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        used.append((pattern, times))
        left -= pattern * times
    return used


#: What tells the pieces of documents apart, but for repeated rows.
ORDER = ["doc_id", "start", "ids_crc32", "doc_tokens"]


def numbered_copies(pieces: DataFrame, same) -> DataFrame:
    """`pieces` with `copy`: 0, and numbers from 0 among rows that are equal in columns `same`.

    Equal rows may be a third of all; they are numbered in blocks. `piece` must be
    unique and the table stored.
    """
    if "doc_id" in same:  # joins drop nulls
        pieces = pieces.withColumn("_doc", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        same = ["_doc", *(c for c in same if c != "doc_id")]
    repeated = cut(pieces.groupBy(*same).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    if repeated.isEmpty():
        return pieces.withColumn("copy", F.lit(0).cast("long")).drop("_doc")
    numbers = spread_ranks(pieces.join(repeated, same, "left_semi").select("piece", *same), same, ["piece"])
    out = pieces.join(numbers.select("piece", F.col("_rank").alias("copy")), "piece", "left")
    return out.withColumn("copy", F.coalesce("copy", F.lit(0).cast("long"))).drop("_doc")


def place(pieces: DataFrame, cfg: Packing = Packing(), order=("piece",)) -> DataFrame:
    """`pieces` (length and others) with sequence_id and offset, gapless within a sequence.

    Pieces must not be longer than a sequence, and the table must be stored. The columns
    `order` must be unique together; where a piece goes depends on its length and theirs alone.
    """
    classed = pieces.withColumn("_class", F.ceil(F.col("length") / cfg.step).cast("int"))
    counts = {r["_class"]: r["n"] for r in classed.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    sizes = np.array(sorted(counts), np.int64)
    demand = np.array([counts[c] for c in sizes.tolist()], np.float64)
    first, spans, used = 0, {c: [] for c in counts}, dict.fromkeys(counts, 0)
    for pattern, times in plan(sizes, demand, cfg.tokens // cfg.step, cfg):
        for k in np.flatnonzero(pattern):
            c, each = int(sizes[k]), int(pattern[k])
            spans[c].append((used[c], each, first))
            used[c] += each * times
        first += times
    lookup = {c: np.array(s, np.int64).reshape(-1, 3) for c, s in spans.items()}

    ranked = spread_ranks(classed, ["_class"], order)
    names = [c for c in ranked.columns if c not in ("_class", "_rank")]

    def run(batches):
        for batch in batches:
            kind, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("_class", "_rank"))
            sequence = np.empty(len(rank), np.int64)
            for c in np.unique(kind):
                own, table = kind == c, lookup[int(c)]
                at = np.searchsorted(table[:, 0], rank[own], "right") - 1
                sequence[own] = table[at, 2] + (rank[own] - table[at, 0]) // table[at, 1]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence)], [*names, "sequence_id"])

    schema = ranked.select(*names).withColumn("sequence_id", F.lit(0).cast("long")).schema
    placed = ranked.mapInArrow(run, schema)
    before = W.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def pack(docs: DataFrame, definition: str, cfg: Packing = Packing(), with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and `ids` if wanted.

    Reads `doc_id` and `text`, so other columns may have any names. Null and empty
    texts are documents of the end id alone. Rows with equal ids are documents of
    their own. A sequence holds at most `tokens` ids; equal choices are settled by id, start
    and check sum, so the order of reading changes nothing. An empty table gives an empty result.
    """
    kind = narrow_kind(definition) if with_ids else "<u4"
    pieces = token_pieces(docs, definition, cfg, kind)
    pieces = cut((pieces if with_ids else pieces.drop("ids")).withColumn("piece", F.monotonically_increasing_id()))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    told = cut(numbered_copies(pieces.drop("ids"), ORDER))
    placed = place(told, cfg, [*ORDER, "copy"])
    if not with_ids:
        return placed.select(*columns)
    # only now do the ids travel, once and in as few bytes as they need
    return widened(placed.hint("merge").join(pieces.select("piece", "ids"), "piece").select(*columns, "ids"), kind)


def sequences(packed: DataFrame, cfg: Packing = Packing()) -> DataFrame:
    """(sequence_id, ids, doc_ids): the ids of each sequence of `pack`, in order, without padding."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
