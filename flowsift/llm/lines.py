"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line is a sequence of words. Two lines are near when one word edit (a word
replaced, put in or taken out) turns one into the other. A line emits its
neighbourhood of deletions as hashed keys: itself without its i-th word, for every i,
and itself whole. Lines that differ in the word at place i meet under (i, rest). A
line with one word more meets the shorter one under the shorter line's whole key.
The edit is then verified on the words. Members of one (i, rest) bucket are all near
each other, so such a bucket needs its first line only, not its pairs.

Emitting the neighbourhood of every line would multiply the text. One edit leaves
the first or the last half of a line as it was, so only lines that share a half with
a different line are expanded, and only by deletions from the other half. A line that shares
none has no partner, so nothing is lost. Until then lines travel as hashes; a bitmap of fixed size then picks out the
few lines and documents whose words are needed (it may let others through, never
the reverse).

Lines are in the order of (doc_id, line_no, hash of the text), nulls first. A line
goes if an equal or near one comes earlier, whether that one stays or not, so the
earliest of any chain stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .tables import fresh, wide_partitions


@dataclass(frozen=True)
class LineDedup:
    min_words: int = 5  # shorter lines go only as repeats within their own document
    near_words: int = 8  # shorter lines are compared for equality only
    bitmap_bits: int = 1 << 23  # of a filter that is broadcast; it never grows


PLACE = ["doc_id", "line_no", "text_hash"]


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text_hash, line): what stands between newlines, all other white space as spaces.

    White space is replaced once per text, where there is any; plain searches are far cheaper here than a pattern.
    A text is hashed before it is taken apart, not once per line.
    """
    spaced, any_other = F.col("text"), F.lit(False)
    for other in "\t\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(other), F.lit(" "))
        any_other = any_other | F.contains(F.col("text"), F.lit(other))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.when(any_other, spaced).otherwise(F.col("text")).alias("text"))
    return keyed.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def words_of(line: Column) -> Column:
    """The words of a line with one space between them; only lines with double spaces are taken apart."""
    apart = F.array_join(F.array_remove(F.split(line, " "), ""), " ")
    return F.when(F.contains(line, F.lit("  ")), apart).otherwise(F.trim(line))


def _count(words: Column) -> Column:
    """How many words there are in a text of words with one space between them."""
    gaps = F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))
    return F.when(words == "", F.lit(0)).otherwise(gaps + 1)


def _first(words: Column, k: Column) -> Column:
    """The first `k` words; the last ones if `k` is below 0."""
    return F.call_function("substring_index", words, F.lit(" "), k)


def _hash(words: Column, own: Column | None = None) -> Column:
    return F.xxhash64(words, F.lit(0).cast("long") if own is None else own)


def _spot(place: str = "") -> Column:
    return F.xxhash64(*(F.col(place + c) for c in PLACE))


def hashed(docs: DataFrame, cfg: LineDedup) -> DataFrame:
    """Every line with words as place, n, `h` and `h2` that stand for the words, and the hashes of its halves.

    A short line's h and h2 also stand for its document. For a pair whose longer line
    has w words the halves have (w - 1) div 2 words each. A line is the longer one or a
    word shorter, so it has two pairs of halves.
    """
    # blank lines go by their text: a filter on the count would be moved below it and count every line a second time
    lines = split_lines(docs).filter(F.trim("line") != "").select(*PLACE, words_of(F.col("line")).alias("words"))
    lines = lines.withColumn("n", _count(F.col("words")))
    own = F.when(F.col("n") < cfg.min_words, F.xxhash64("doc_id", "text_hash")).otherwise(F.lit(0).cast("long"))
    halves = []
    for more in (0, 1):
        w = F.col("n") + more
        k = F.floor((w - 1) / 2).cast("int")
        halves += [F.xxhash64(w, F.lit(1), _first(F.col("words"), k)), F.xxhash64(w, F.lit(2), _first(F.col("words"), -k))]
    near = F.col("n") >= cfg.near_words
    return lines.select(
        *PLACE, "n", _hash(F.col("words"), own).alias("h"), F.xxhash64(F.lit(7), "words", own).alias("h2"),
        *(F.when(near, half).alias(f"half{i}") for i, half in enumerate(halves)),
    )


def first_of_equals(hashes: DataFrame) -> DataFrame:
    """One row per distinct line: h, h2, its earliest place, its number of rows and of words."""
    return hashes.groupBy("h", "h2").agg(F.min(F.struct(*PLACE)).alias("place"), F.count("*").alias("rows"), F.min("n").alias("n"))


def sharing_halves(hashes: DataFrame, cfg: LineDedup) -> DataFrame:
    """(h, front, back): long lines that share a half with a different line, and whether they do as the longer of the two.

    `front` is true for the first half and `back` for the last one.
    """
    keyed = hashes.filter(F.col("n") >= cfg.near_words).select("h", F.posexplode(F.array(*(f"half{i}" for i in range(4)))).alias("which", "half"))
    many = keyed.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("half")
    many = cut(many)
    likely = marked(keyed, F.col("half"), bitmap(many, F.col("half"), cfg), "held", cfg).filter("held").select("h", "which", "half")
    shared = likely.join(many.hint("merge"), "half").groupBy("h")
    return shared.agg(F.max(F.col("which") == 0).alias("front"), F.max(F.col("which") == 1).alias("back"))


def bitmap(keys: DataFrame, key: Column, cfg: LineDedup) -> DataFrame:
    """(word, bits): a filter of `key` with at most `bitmap_bits` / 64 rows, whatever the number of keys."""
    at = F.pmod(key, F.lit(cfg.bitmap_bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    return cut(keys.groupBy(F.floor(at / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits")))


def marked(df: DataFrame, key: Column, bits: DataFrame, name: str, cfg: LineDedup) -> DataFrame:
    """`df` with boolean `name`: whether `key` may be in the filter."""
    at = F.pmod(key, F.lit(cfg.bitmap_bits))
    word, found, extra = fresh(df, "word"), fresh(df, "bits"), fresh(df, "own_key")
    filled = F.broadcast(bits.select(F.col("word").alias(word), F.col("bits").alias(found)))
    bit = F.call_function("shiftright", F.col(found), F.pmod(F.col(extra), F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    joined = df.withColumn(extra, at).withColumn(word, F.floor(F.col(extra) / 64).cast("long")).join(filled, word, "left")
    return joined.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(word, found, extra)


def _without(words: Column, at: Column, n: Column | None = None) -> Column:
    """`words`, of which there are `n`, without the one at `at`, counted from 0."""
    return F.trim(F.concat(_first(words, at), F.lit(" "), _first(words, at + 1 - (_count(words) if n is None else n))))


def deletions(lines: DataFrame) -> DataFrame:
    """(h, n, place, at, rest): the distinct `lines` without their word `at`, as hashes.

    A partner that differs at a word of the last half shares the first one, and the other way round;
    so a line is taken apart in the half opposite to one that it shares. The shared half is put back whole.
    """
    low = F.floor(F.col("n") / 2).cast("int")
    first, last = _first(F.col("words"), low), _first(F.col("words"), low - F.col("n"))
    sides = F.array(
        F.struct(F.col("front").alias("open"), F.lit(True).alias("upper"), (F.col("n") - low).alias("m"), last.alias("part"), first.alias("kept")),
        F.struct(F.col("back").alias("open"), F.lit(False).alias("upper"), low.alias("m"), first.alias("part"), last.alias("kept")),
    )
    halves = lines.select("h", "n", "place", F.explode(sides).alias("side")).filter("side.open AND side.m > 0")
    each = halves.select("h", "n", "place", "side.*", F.explode(F.sequence(F.lit(0), F.col("side.m") - 1)).alias("i"))
    part = _without(F.col("part"), F.col("i"), F.col("m"))
    rest = F.when(F.col("upper"), F.concat("kept", F.lit(" "), part)).otherwise(F.concat(part, F.lit(" "), "kept"))
    at = F.when(F.col("upper"), F.col("n") - F.col("m")).otherwise(F.lit(0)) + F.col("i")
    return each.select("h", "n", "place", at.alias("at"), _hash(F.trim(rest)).alias("rest"))


def meeting(gone: DataFrame, whole: DataFrame, cfg: LineDedup) -> DataFrame:
    """Those of the deletions `gone` whose key another deletion or a whole line has, too.

    Most deletions meet nothing, so bare keys are counted first, and places travel
    for the keys that occur twice only.
    """
    keys = gone.select("rest").unionByName(whole.select(F.col("h").alias("rest")))
    twice = cut(keys.groupBy("rest").agg(F.count("*").alias("m")).filter("m > 1").select("rest"))
    likely = marked(gone, F.col("rest"), bitmap(twice, F.col("rest"), cfg), "held", cfg).filter("held").drop("held")
    return cut(likely.join(twice.hint("merge"), "rest", "left_semi"))


def near_earlier(lines: DataFrame, cfg: LineDedup) -> DataFrame:
    """(h): those of the distinct `lines` (h, words, n, place, front, back) that are near an earlier one of them."""
    whole = lines.select("h", "place")
    gone = cut(deletions(lines))
    first = F.min(F.struct("place", "h")).alias("first")
    gone = meeting(gone, whole, cfg)
    # a word replaced: the first line of each (place of the word, rest)
    other = gone.groupBy("rest", "at", "n").agg(first, F.count("*").alias("m")).filter("m > 1").drop("m")
    replaced = gone.join(other, ["rest", "at", "n"]).filter("first.place < place")
    replaced = replaced.select("h", F.col("first.h").alias("by"), "at", F.lit(0).alias("more"))
    # a word put in or taken out: the longer line's deletion is the shorter line
    met = gone.join(whole.select(F.col("h").alias("rest"), F.col("place").alias("short")), "rest")
    shorter = met.filter("short < place").select("h", F.col("rest").alias("by"), "at", F.lit(1).alias("more"))
    longer = gone.groupBy("rest").agg(F.min(F.struct("place", "h", "at")).alias("first")).join(
        whole.select(F.col("h").alias("rest"), F.col("place").alias("short")), "rest"
    ).filter("first.place < short")
    longer = longer.select(F.col("rest").alias("h"), F.col("first.h").alias("by"), F.col("first.at").alias("at"), F.lit(-1).alias("more"))
    found = replaced.unionByName(shorter).unionByName(longer).distinct()
    mine = lines.select("h", F.col("words").alias("x"))
    theirs = lines.select(F.col("h").alias("by"), F.col("words").alias("y"))
    x = F.when(F.col("more") >= 0, _without(F.col("x"), F.col("at"))).otherwise(F.col("x"))
    y = F.when(F.col("more") <= 0, _without(F.col("y"), F.col("at"))).otherwise(F.col("y"))
    return found.join(mine, "h").join(theirs, "by").filter(x == y).select("h").distinct()


def dropped_lines(docs: DataFrame, cfg: LineDedup = LineDedup()) -> DataFrame:
    """(doc_id, text_hash, drops): the numbers, from 0, of the lines that go, per document that loses any."""
    hashes = cut(hashed(docs, cfg))
    unique = cut(first_of_equals(hashes))
    some = unique.join(sharing_halves(hashes, cfg).hint("merge"), "h")
    some = cut(some.select("h", "n", "place", "front", "back", _spot("place.").alias("spot")))
    at_spot = split_lines(docs).withColumn("spot", _spot())
    held = marked(at_spot, F.col("spot"), bitmap(some, F.col("spot"), cfg), "held", cfg).filter("held")
    held = held.select("spot", words_of(F.col("line")).alias("words"))
    expanded = some.join(held.hint("merge"), "spot").dropDuplicates(["spot"]).drop("spot")
    expanded = cut(expanded.repartition(wide_partitions(docs.sparkSession), "h"))  # few lines, but many deletions
    near = cut(near_earlier(expanded, cfg))
    over = unique.join(near.withColumn("near", F.lit(True)), "h", "left").filter("rows > 1 OR near")
    over = cut(over.select("h", "h2", "place", F.coalesce("near", F.lit(False)).alias("near")))
    rows = hashes.select(*PLACE, "h", "h2")
    rows = marked(rows, F.col("h"), bitmap(over, F.col("h"), cfg), "held", cfg).filter("held").drop("held")
    late = rows.join(over.hint("merge"), ["h", "h2"]).filter(F.col("near") | (F.struct(*PLACE) > F.col("place")))
    return cut(late.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("drops")))


def dedup_lines(docs: DataFrame, cfg: LineDedup = LineDedup(), before: str = "lines_before", dropped: str = "lines_dropped") -> DataFrame:
    """`docs` with shorter texts, and two more columns, the numbers of lines there were and that went.

    A line is what stands between newlines; its words are divided by ASCII white space.
    Lines of `min_words` words or more go if an equal line, or for `near_words` or more
    one that a single word edit away, comes earlier anywhere in the table; shorter ones
    only as repeats within their document. Blank lines stay. A null text stays null and
    an empty one empty, both without lines. Rows with the same id and text are one
    document and are treated alike; a null id comes before all others. All other
    columns are kept as they are, whatever their names: if `docs` has a column `before`
    or `dropped`, the new one's name gets underscores at its end. An empty table gives
    an empty one.
    """
    before, dropped = fresh(docs, before), fresh(docs, dropped)
    drops = dropped_lines(docs, cfg)
    key, seen, own = fresh(docs, "text_hash"), fresh(docs, "seen"), fresh(docs, "row_id")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    spot = F.xxhash64("doc_id", key)
    flagged = marked(keyed, spot, bitmap(drops, F.xxhash64("doc_id", "text_hash"), cfg), seen, cfg)
    gone = drops.select(F.col("doc_id").alias(own), F.col("text_hash").alias(key + "_"), F.col("drops").alias(key + "_drops"))
    hit = flagged.filter(F.col(seen)).join(
        gone.hint("merge"), (F.col(key) == F.col(key + "_")) & F.col("doc_id").eqNullSafe(F.col(own)), "left"
    )
    none = F.coalesce("text", F.lit("")) == ""
    # the text is split once per row, not once per line
    parts = own + "_parts"
    hit = hit.withColumn(parts, F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(key + "_drops"))
    hit = hit.withColumn(own + "_lines", F.when(none, F.lit(0)).otherwise(F.size(parts)))
    text = F.when(F.col(key + "_drops").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col(parts), i)), "\n")
    )
    short = hit.withColumn("text", text).select(
        *docs.columns, F.col(own + "_lines").alias(before), F.coalesce(F.size(key + "_drops"), F.lit(0)).alias(dropped)
    )
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    count = F.when(none, F.lit(0)).otherwise(ends + 1)
    same = flagged.filter(~F.col(seen)).select(*docs.columns, count.alias(before), F.lit(0).alias(dropped))
    return short.unionByName(same)
