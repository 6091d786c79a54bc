"""Chat formatting by rotating perspectives, in DataFrame functions only.

For every participant of a conversation the dialogue is written once more with that
participant as the assistant, everybody else as a named user, and a mask that says
which characters are to be learnt: the assistant's words and what ends them.

Turns are numbered by a distributed rank and written out in parts of a bounded number
of turns, so neither a conversation that holds much of the table nor a turn number
shared by many rows has to fit into one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .tables import ordered_ranks


@dataclass(frozen=True)
class Chat:
    system: str = "system"  # the role that is nobody's perspective
    turns: int = 64  # of a part
    end: str = "<|end|>\n"


def plain(text: Column) -> Column:
    """`text` in which nothing can be taken for a marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def segments(turns: DataFrame, cfg: Chat = Chat()) -> DataFrame:
    """(conv_id, perspective, rank, head, body, learnt): one row per turn and participant."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    ranked = ordered_ranks(rows, ["conv_id"], ["turn", "role", "text"], "rank")
    people = rows.filter(F.col("role") != cfg.system).select(F.col("conv_id").alias("conv"), F.col("role").alias("perspective")).distinct()
    met = ranked.join(people, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    mine = F.col("role") == F.col("perspective")
    head = F.when(mine, F.lit("<|assistant|>\n")).when(F.col("role") == cfg.system, F.lit("<|system|>\n"))
    head = head.otherwise(F.concat(F.lit("<|user:"), plain(F.col("role")), F.lit("|>\n")))
    return met.select(
        "conv_id", "perspective", "rank", head.alias("head"), F.concat(plain(F.col("text")), F.lit(cfg.end)).alias("body"), mine.alias("learnt")
    )


def perspectives(turns: DataFrame, cfg: Chat = Chat()) -> DataFrame:
    """(conv_id, perspective, part, turns, text, mask, learnt_chars): every dialogue from every participant's side.

    `mask` lists the learnt spans of the part's text as start-end, end exclusive, in
    code points. Reads `conv_id`, `turn`, `role` and `text`, so other columns may have
    any names. Turns are in the order of (turn, role, text), nulls first; equal rows
    count once; a null role is called unknown and a null text is empty. Rows with a
    null conv_id are one conversation. A conversation in which only the system speaks
    has no perspective and no row. An empty table gives an empty result.
    """
    part = F.floor(F.col("rank") / cfg.turns)
    grouped = segments(turns, cfg).groupBy("conv_id", "perspective", part.cast("long").alias("part"))
    # at most cfg.turns turns
    rows = grouped.agg(F.array_sort(F.collect_list(F.struct("rank", "head", "body", "learnt"))).alias("rows"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("learnt"))

    def step(state, r):
        first = state["at"] + F.length(r["head"])
        last = first + F.length(r["body"])
        span = F.when(r["learnt"], F.array(F.concat_ws("-", first.cast("string"), last.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            last.alias("at"), F.concat(state["spans"], span).alias("spans"),
            (state["learnt"] + F.when(r["learnt"], F.length(r["body"])).otherwise(0)).alias("learnt"),
        )

    done = F.aggregate("rows", start, step).alias("done")
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["head"], r["body"])), "")
    return rows.select("conv_id", "perspective", "part", F.size("rows").alias("turns"), text.alias("text"), done).select(
        "conv_id", "perspective", "part", "turns", "text",
        F.array_join("done.spans", ",").alias("mask"), F.col("done.learnt").alias("learnt_chars"),
    )
