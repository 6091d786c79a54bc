"""Personal data, in DataFrame functions only.

A regular expression per kind proposes spans: its matches, and the text between
them, whose lengths add up to the positions. Validators confirm a proposal: parts of
an address below 256, Luhn's sum for cards, mod 97 for bank accounts, digit counts
for telephones. A bank account is proposed wherever one can begin, and ends where its
country's length or, for other countries, mod 97 says. Words shortly before and after a span adjust its score. Kinds marked `base` are
reported whenever they are valid; the others only with a score of `accept` or more.

The patterns use possessive repetition and, where a match can only begin at the
start of a run, say so; both leave the matches as they are and keep the time
proportional to the text, also for runs of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    base: bool
    score: float
    context: str  # words that raise the score, as a regular expression over lower-case text
    group: int = 0  # of the pattern, that holds the proposal; what is matched beyond it may begin others


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        True, 0.8, "mail|contact|write",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, 0.6, "ip|host|server|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", True, 0.7, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True, 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))[A-Z]{2}", False, 0.7, "iban|account|bank", 1),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", False, 0.3, "ssn|social security|tax id"),
)
BASE = [k.name for k in KINDS if k.base]
ACCEPT = 0.6
BONUS = 0.3
#: Characters of the accounts of each country, without spaces.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG DZ",
    25: "LY PT ST", 26: "IS TR BI", 27: "BF CF CG CM DJ FR GA GQ GR IT KM MC MR SM TD MG ML CI SN BJ", 28: "AL AZ BY CY DO GT HU LB NI PL SV HN",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 33: "LC RU",
}
REACH = 40  # characters before and after a span that are searched for context
LONGEST = 64  # characters of a bank account with a space before each but the first four
SEEN = "struct<found:string,before:int,size:int,context:string,after:string,start:int>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        digit = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _mod97(text: Column) -> Column:
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest, c):
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _account_size(text: Column) -> Column:
    """How much of a proposal is a bank account, or null.

    The proposal runs on over spaces, so every part that ends before a space may be the
    account. The length of its country decides; without one the longest part that passes
    mod 97 does. The whole proposal may pass in any case.
    """
    sizes = F.create_map(*(F.lit(x) for size, names in LENGTHS.items() for name in names.split() for x in (name, size)))
    whole = F.length(text)
    passes = F.filter(
        F.sequence(whole, F.lit(15), F.lit(-1)),
        lambda e: F.when((e == whole) | (F.substring(text, e + 1, F.lit(1)) == " "), _mod97(F.substring(text, F.lit(1), e))).otherwise(False),
    )

    def plain(e):
        return F.length(F.replace(F.substring(text, F.lit(1), e), F.lit(" "), F.lit("")))

    due = F.try_element_at(sizes, F.substring(text, 1, 2))
    of_country = F.get(F.filter(passes, lambda e: plain(e) == due), F.lit(0))
    other = F.get(F.filter(passes, lambda e: due.isNull() | (e == whole)), F.lit(0))
    return F.coalesce(of_country, other)


def _accounts(seen: Column) -> Column:
    """The bank accounts among the proposals `seen`, none of which overlap.

    Inside of a proposal that failed another may begin with a word, not within one.
    """
    sized = F.transform(seen, lambda p: F.struct(p.alias("p"), _account_size(p["found"]).alias("size")))
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("past"), F.array().cast(f"array<{SEEN}>").alias("seen"))

    def step(state, row):
        p, size = row["p"], row["size"]
        opens = p["start"] >= state["past"]
        begins = opens | p["context"].rlike(r"[^A-Za-z0-9]\z")
        good = size.isNotNull() & (p["start"] >= state["at"]) & begins
        end = p["start"] + F.when(good, size).otherwise(F.length(p["found"]))
        kept = F.struct(
            F.substring(p["found"], F.lit(1), size).alias("found"), p["before"].alias("before"), size.alias("size"),
            p["context"].alias("context"), F.substring(p["after"], size - 1, F.lit(REACH)).alias("after"), p["start"].alias("start"),
        )
        return F.struct(
            F.when(good, end).otherwise(state["at"]).alias("at"),
            F.when(opens, end).otherwise(state["past"]).alias("past"),
            F.when(good, F.concat(state["seen"], F.array(kept))).otherwise(state["seen"]).alias("seen"),
        )

    return F.aggregate(sized, none, step, lambda s: s["seen"])


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":

        def small(part):
            digits = F.ltrim(part, F.lit("0"))
            return F.when(F.length(digits) <= 3, F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255).otherwise(False)

        return F.forall(F.split(text, r"\."), small)
    if kind == "card":
        return F.when(F.length(_digits(text)).between(14, 19), _luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    return F.lit(True)


def spans_of(text: Column, matches: Column, number: int) -> Column:
    """The valid matches of a kind as structs: start, number of the kind, end (both in code points), kind, score.

    Matches and the parts between them are read in turn; `at` is where the next part begins.
    """
    kind = KINDS[number]
    parts = F.split(text, kind.pattern, -1)
    wide = REACH + LONGEST
    pairs = F.transform(
        matches,
        lambda m, i: F.struct(
            m.alias("found"), F.length(F.get(parts, i)).alias("before"), (F.lit(2) if kind.group else F.length(m)).alias("size"),
            F.substring(F.get(parts, i), -REACH, REACH).alias("context"), F.substring(F.get(parts, i), 1, wide).alias("after"), F.lit(0).alias("start"),
        ),
    )

    def taken(p):
        return F.substring(p["found"], F.lit(1), p["size"])

    def row_of(p, **new):
        return F.struct(*(new.get(c, p[c]).alias(c) for c in ("found", "before", "size", "context", "after", "start")))

    none = F.array().cast(f"array<{SEEN}>").alias("seen")

    def back(state, p):
        head = F.substring(F.concat(p["after"], taken(p), state["head"]), 1, wide)
        return F.struct(head.alias("head"), F.concat(state["seen"], F.array(row_of(p, after=state["head"]))).alias("seen"))

    end = F.struct(F.substring(F.get(parts, F.size(matches)), 1, wide).alias("head"), none)
    pairs = F.reverse(F.aggregate(F.reverse(pairs), end, back, lambda s: s["seen"]))

    def step(state, p):
        start = state["at"] + p["before"]
        context = F.substring(F.concat(state["tail"], p["context"]), -REACH, REACH)
        tail = F.substring(F.concat(context, taken(p)), -REACH, REACH)
        row = row_of(p, context=context, start=start)
        return F.struct((start + p["size"]).alias("at"), tail.alias("tail"), F.concat(state["seen"], F.array(row)).alias("seen"))

    seen = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none), step, lambda s: s["seen"])
    seen = _accounts(seen) if kind.name == "iban" else F.filter(seen, lambda p: _valid(kind.name, p["found"]))

    def span(p):
        near = F.when(F.lower(F.concat(p["context"], F.lit("\n"), F.substring(p["after"], 1, REACH))).rlike(kind.context), F.lit(BONUS)).otherwise(F.lit(0.0))
        return F.struct(
            p["start"].alias("start"), F.lit(number).alias("number"), (p["start"] + p["size"]).alias("end"), F.lit(kind.name).alias("kind"),
            F.least(F.lit(1.0), F.lit(kind.score) + near).alias("score"),
        )

    made = F.transform(seen, span)
    return made if kind.base else F.filter(made, lambda s: s["score"] >= ACCEPT)


SPANS = "array<struct<start:int,number:int,end:int,kind:string,score:double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, found): per row the spans of personal data, by start and then in the order of `KINDS`.

    Spans have start, end (exclusive, in code points), kind and score. Reads `doc_id`
    and `text`, so other columns may have any names. Null and empty texts have no
    spans; repeated rows each get a row; a null id stays null; kinds may overlap each
    other, matches of one kind never do. An empty table gives an empty result.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = base.select("*", *(F.regexp_extract_all("text", F.lit(k.pattern), F.lit(k.group)).alias(f"m{i}") for i, k in enumerate(KINDS)))
    none = F.array().cast(SPANS)
    each = [F.when(F.size(f"m{i}") > 0, spans_of(F.col("text"), F.col(f"m{i}"), i)).otherwise(none).alias(f"s{i}") for i in range(len(KINDS))]
    spans = found.select("doc_id", *each)
    return spans.select("doc_id", F.array_sort(F.concat(*(f"s{i}" for i in range(len(KINDS))))).alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

