"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INTERNAL_PREFIX = "172.31."
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def touches_internal(src: str = "src_ip", dst: str = "dst_ip", prefix: str = INTERNAL_PREFIX) -> Column:
    """True for flows with an internal address on either end."""
    return F.col(src).startswith(prefix) | F.col(dst).startswith(prefix)


def view_of(entity: str = "entity", prefix: str = INTERNAL_PREFIX) -> Column:
    """`internal` or `external`, by address prefix."""
    return F.when(F.col(entity).startswith(prefix), F.lit("internal")).otherwise(F.lit("external"))


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double; 0 where the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def floor_time(ts: Column, seconds: Column, offset: Column | int = 0) -> Column:
    """Start of the left-closed window of `seconds` length that holds `ts`.

    Works on wall-clock timestamps and takes the length, and the offset of the
    grid, per row, so several sizes can be produced by one expression.
    """
    since = F.timestamp_diff("SECOND", F.expr(EPOCH), ts) - F.lit(offset)
    return F.timestamp_add("SECOND", (since - F.pmod(since, seconds) + F.lit(offset)).cast("int"), F.expr(EPOCH))


def label_time(win_start: Column, hours: int = 4) -> Column:
    """Window start as shown in output labels (local time of the capture)."""
    return win_start - F.expr(f"INTERVAL {int(hours)} HOURS")


def uniform(*cols, seed: int = 0) -> Column:
    """Repeatable pseudo-random number in [0, 1) from the given columns."""
    mask = F.lit((1 << 52) - 1)
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(mask) / F.lit(float(1 << 52))
