"""Sharding by vector bin packing.

Groups of equal texts stay together and have three sizes: bytes, words and rows. A
group goes to the shard where the dot product of its sizes with what the shard has
left is highest, largest groups first (Panigrahy, Talwar, Uyeda and Wieder,
"Heuristics for Vector Bin Packing", 2011).

The number of groups grows with the table, so only groups above a fixed share of a
shard are placed one by one; the others are bundled by hash into a fixed number of
bundles, and groups too large for a shard are cut into pieces. What is placed is
therefore bounded by the number of shards, whatever the number of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .tables import spread_ranks

SIZES = ["bytes", "words", "rows"]


@dataclass(frozen=True)
class Sharding:
    shards: int = 40
    row_bytes: int = 16  # what a row takes besides its text
    grains: int = 256  # bundles per shard; groups larger than a bundle's share are placed alone
    most: float = 0.5  # of a shard that a group may take before it is cut
    weights: tuple = (4.0, 1.0, 1.0)  # of bytes, words and rows in the dot product; the law is about bytes


def assign(items: np.ndarray, shards: int, capacity: np.ndarray, weights) -> np.ndarray:
    """A shard for each row of `items` (sizes), largest first; ties go to the lowest shard."""
    share = items / np.maximum(capacity, 1e-9)
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.max(1))) if len(items) else []:
        fit = left @ (share[i] * weights)
        out[i] = int(np.argmax(fit))
        left[out[i]] -= share[i]
    return out


def measured(docs: DataFrame, cfg: Sharding) -> DataFrame:
    """(doc_id, size, text_crc32, words, h): the sizes of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + cfg.row_bytes).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.xxhash64(text).alias("h"),
    )


def shard(docs: DataFrame, cfg: Sharding = Sharding()) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: the shards' sums of `size` are nearly equal, and so are their
    words and rows. Reads `doc_id` and `text`, so other columns may have any names. A
    null text counts as empty. Equal texts, also of repeated rows, share a shard unless
    they would take more than `most` of one. Slots are numbered from 0 within a shard
    without gaps, in no order that means anything. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = cut(measured(docs, cfg))
    sums = [F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    capacity = np.array([float(total[c] or 0) for c in SIZES]) / cfg.shards
    groups = cut(rows.groupBy("h").agg(*sums))
    share = F.greatest(*(F.col(c) / max(v, 1e-9) for c, v in zip(SIZES, capacity)))
    # at most shards * grains groups per size can be as large as a grain
    large = cut(groups.filter(share >= 1 / cfg.grains).select("h", F.ceil(share / cfg.most).cast("int").alias("pieces")))
    bundles = cfg.shards * cfg.grains
    known = rows.join(F.broadcast(large), "h", "left")
    unit = F.when(F.col("pieces").isNull(), F.pmod("h", F.lit(bundles))).otherwise(F.col("h"))
    piece = F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.col("pieces"))).cast("int")
    known = known.select("doc_id", "size", "text_crc32", "words", unit.alias("unit"), piece.alias("piece"))
    items = known.groupBy("unit", "piece").agg(*sums).orderBy("unit", "piece").collect()
    placed = assign(np.array([[r[c] for c in SIZES] for r in items], float).reshape(len(items), 3), cfg.shards, capacity, np.array(cfg.weights))
    where = spark.createDataFrame(
        [(r["unit"], r["piece"], int(s)) for r, s in zip(items, placed)], "unit long, piece int, shard int"
    )
    dealt = known.join(F.broadcast(where), ["unit", "piece"])
    ranked = spread_ranks(dealt.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id", "text_crc32", "size"])
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("_rank").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
