"""License scans: an exact set-similarity join of text blocks with license notices.

A block is any stretch of words a quarter longer than a notice, so that notices are
found across lines and inside long paragraphs. A block meets a notice when it holds at
least `percent` of the notice's distinct words. Of the filters for such joins
(Chaudhuri, Ganti and Kaushik, ICDE 2006; Bayardo, Ma and Srikant, WWW 2007; Xiao et
al., "Efficient similarity joins for near-duplicate detection", WWW 2008):

* order: the words of the notices are counted over all documents, rarest first;
* prefix: a block that may miss k words of a notice holds one of its k + 1 rarest, so
  only places of those words are joined with the notices;
* length: a text shorter than the words a block must hold is left out;
* position: at a notice's word number k the blocks with rarer ones are left to those,
  so the notice's words from number k on, as far as they stand around the place, must
  suffice.

What is left is compared block by block. Nothing is dropped that meets the threshold.
DataFrame functions only. The notices are a parameter, so their words, the counts of
these words and the index of prefixes have a size that no document changes.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import cut

# Phrases that count wherever their words stand in a row, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License notices by label.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}

PERCENT = 90
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def notice_words(text: str) -> list[str]:
    return [w for w in re.split(NO_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def span_of(words: Sequence[str]) -> int:
    """Words of a block that is held against a notice."""
    return len(words) + len(words) // 4


def needed(words: Sequence[str], percent: int) -> int:
    """Distinct words of a notice that a block must hold."""
    return -(-percent * len(set(words)) // 100)


def text_words(column):
    """The words of a text in order; none of a null."""
    lowered = F.translate(F.coalesce(column, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, NO_WORD), lambda w: w != "")


def word_counts(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many rows of `docs` each word of `vocabulary` stands."""
    known = F.array(*[F.lit(w) for w in sorted(vocabulary)])
    held = docs.select(F.explode(F.array_intersect(text_words(F.col("text")), known)).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: found.get(w, 0) for w in vocabulary}


def prefix_index(notices: Mapping[str, Sequence[str]], counts: Mapping[str, int], percent: int = PERCENT) -> list[tuple]:
    """(word, place, notice, label, words, need, span): the words of each notice that can lead to it."""
    out, number = [], 0
    for label, texts in notices.items():
        for text in texts:
            words = notice_words(text)
            order = sorted(set(words), key=lambda w: (counts[w], w))
            need = needed(words, percent)
            out += [(w, k, number, label, order, need, span_of(words)) for k, w in enumerate(order[: len(order) - need + 1])]
            number += 1
    return out


def _index_table(spark, index: list[tuple]) -> DataFrame:
    def row(word, place, notice, label, words, need, span):
        return F.struct(
            F.lit(word).alias("word"), F.lit(place).alias("place"), F.lit(notice).alias("notice"), F.lit(label).alias("label"),
            F.array(*[F.lit(w) for w in words]).alias("words"), F.lit(need).alias("need"), F.lit(span).alias("span"),
        )

    return spark.range(1).select(F.inline(F.array(*[row(*x) for x in index])))


def _phrase_places(phrase: str, label: str, places):
    """(label, start) for those of `places` at which the phrase begins."""
    first, *rest = notice_words(phrase)

    def begins(i):
        ok = F.get("words", i) == first
        for k, w in enumerate(rest, 1):
            ok = ok & F.coalesce(F.get("words", i + k) == w, F.lit(False))
        return ok

    return F.transform(F.filter(places, begins), lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))


def _blocks(near: DataFrame) -> DataFrame:
    """The best block around each place of a prefix word, if it meets the threshold."""
    local = F.slice("around", F.greatest(F.col("at") - F.col("span") + 1, F.lit(0)) + 1, F.least("at", F.col("span") - 1) + F.col("span"))
    rest = F.slice("words", F.col("place") + 1, F.size("words"))
    near = near.withColumn("local", local).filter(F.size(F.array_intersect("local", rest)) >= F.col("need"))
    own = F.least(F.col("at"), F.col("span") - 1)  # the prefix word's place in `local`
    starts = F.filter(F.sequence(F.lit(0), own), lambda s: F.array_contains(F.col("words"), F.get("local", s)))
    blocks = F.transform(
        starts,
        lambda s: F.struct(F.size(F.array_intersect(F.slice("local", s + 1, F.col("span")), F.col("words"))).alias("held"), (-s).alias("less")),
    )
    best = near.withColumn("own", own).withColumn("best", F.array_max(blocks)).filter(F.col("best.held") >= F.col("need"))
    start = F.col("pos") - F.col("own") - F.col("best.less")
    return best.select(
        "row",
        F.struct(
            "label", F.col("notice").alias("notice"), start.cast("long").alias("start"),
            F.least(F.col("span"), F.col("n_words") - start).cast("long").alias("length"),
            (F.col("best.held") / F.size("words")).alias("containment"),
        ).alias("block"),
    )


def scan_licenses(docs: DataFrame, notices: Mapping[str, Sequence[str]] = NOTICES, phrases: Mapping[str, str] = PHRASES, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, phrases, blocks.

    `phrases` lists (label, start) of every place where a phrase's words stand in a row,
    by start. `blocks` lists (label, notice, start, length, containment) of the text
    blocks that meet a notice: for each place of a rare word of the notice the block
    around it that holds most of the notice's words, the first of equal ones. Starts
    are words from 0. Words are runs of ASCII digits and letters, A-Z lower-cased, and of
    all characters beyond ASCII. A null or empty text has no words and meets nothing; repeated rows
    give repeated rows, a null id stays null. Reads `doc_id` and `text` only. Whole texts are scanned. An
    empty table gives an empty result.
    """
    vocabulary = {w for texts in notices.values() for t in texts for w in notice_words(t)}
    index = prefix_index(notices, word_counts(docs, vocabulary), percent) if vocabulary else []
    prefix = sorted({x[0] for x in index})
    reach = max((x[-1] for x in index), default=1) - 1
    wanted = [F.lit(w) for w in sorted({*prefix, *(notice_words(p)[0] for p in phrases)})] or [F.lit("")]
    n = F.size("words")
    places = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", i).isin(*wanted))).otherwise(F.array().cast("array<int>"))
    read = docs.select("doc_id", text_words(F.col("text")).alias("words")).withColumn("places", places)
    said = [_phrase_places(p, label, F.col("places")) for p, label in phrases.items()]
    kind = "array<struct<label:string,start:bigint>>"
    said = F.array_sort(F.concat(*said), lambda x, y: F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(
        F.when(x["label"] < y["label"], -1).when(x["label"] > y["label"], 1).otherwise(0))) if said else F.array().cast(kind)

    def seen(i):
        first = F.greatest(i - reach, F.lit(0))
        return F.struct(i.alias("pos"), (i - first).alias("at"), F.slice("words", first + 1, i - first + reach + 1).alias("around"))

    rare = F.filter("places", lambda i: F.get("words", i).isin(*([F.lit(w) for w in prefix] or [F.lit("")])))
    stored = cut(
        read.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", n.cast("long").alias("n_words"), said.alias("phrases"), F.transform(rare, seen).alias("rare")
        )
    )
    block = "struct<label:string,notice:int,start:bigint,length:bigint,containment:double>"
    if not index:
        return stored.select("doc_id", "n_words", "phrases", F.array().cast(f"array<{block}>").alias("blocks"))
    near = stored.filter(F.size("rare") > 0).select("row", "n_words", F.inline("rare")).withColumn("word", F.get("around", F.col("at")))
    near = near.join(F.broadcast(_index_table(docs.sparkSession, index)), "word").filter(F.least("n_words", F.col("span")) >= F.col("need"))
    found = _blocks(near).distinct().groupBy("row").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    return (
        stored.select("row", "doc_id", "n_words", "phrases")
        .join(found, "row", "left")
        .select("doc_id", "n_words", "phrases", F.coalesce("blocks", F.array().cast(f"array<{block}>")).alias("blocks"))
    )
