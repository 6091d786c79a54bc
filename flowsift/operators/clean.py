"""From raw text flows to typed flows of a capture day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import touches_internal
from ..sources.flows import BAD_LINE, RATE_COLUMNS, RAW_COLUMNS

TIME_FORMAT = "d/M/yyyy h:mm:ss a"


def drop_noise_rows(raw: DataFrame) -> DataFrame:
    """Missing cells become '0'; repeated headers and rows without a time go."""
    known = [c for c in [*RAW_COLUMNS, *RATE_COLUMNS] if c in raw.columns]
    return (
        raw.na.fill("0", known)
        .filter(F.col("`Src Port`") != "Src Port")
        .filter(F.col("Timestamp") != "0")
    )


def _typed(source: str, kind: str, strict: bool):
    """The cell of a raw column as a value of type `kind`."""
    cell = F.col(f"`{source}`")
    if kind != "timestamp_ntz":
        return cell.cast(kind) if strict else cell.try_cast(kind)
    fmt = F.lit(TIME_FORMAT)
    return F.to_timestamp_ntz(cell, fmt) if strict else F.try_to_timestamp(cell, fmt).cast(kind)


def clean_flows(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Typed flows under our names.

    With `strict` a malformed cell fails the job. Otherwise it becomes null;
    `malformed` picks those rows and `well_formed` the others. `quarantine` gives
    the text of what is not well-formed.
    """
    rows = drop_noise_rows(raw)
    out = []
    for source, (name, kind) in {**RAW_COLUMNS, **RATE_COLUMNS}.items():
        if source in rows.columns:
            out.append(_typed(source, kind, strict).alias(name))
    keep = [c for c in rows.columns if c not in RAW_COLUMNS and c not in RATE_COLUMNS]
    return rows.select(*out, *keep)


def quarantine(raw: DataFrame) -> DataFrame:
    """Raw rows that are no well-formed flows, as their original text, with `unreadable`: the columns at fault.

    Filled and repeated-header rows are judged as `clean_flows` does, so its well-formed
    rows and these are all rows that remain after `drop_noise_rows`. Rows read with
    `keep_lines` are also here if they had too many or too few cells; their fault is `BAD_LINE`.
    """
    rows = drop_noise_rows(raw)
    faults = [
        F.when(_typed(source, kind, False).isNull(), F.lit(source))
        for source, (_, kind) in {**RAW_COLUMNS, **RATE_COLUMNS}.items()
        if source in rows.columns and kind != "string"
    ]
    if BAD_LINE in rows.columns:
        faults.append(F.when(F.col(BAD_LINE).isNotNull(), F.lit(BAD_LINE)))
    return rows.withColumn("unreadable", F.array_compact(F.array(*faults))).filter(F.size("unreadable") > 0)


def malformed(flows: DataFrame) -> DataFrame:
    """Rows of a lenient `clean_flows` with a cell, or a line, that could not be read."""
    return flows.filter(_any_null(flows))


def well_formed(flows: DataFrame) -> DataFrame:
    return flows.filter(~_any_null(flows))


def _any_null(flows: DataFrame):
    names = [n for n, _ in {**RAW_COLUMNS, **RATE_COLUMNS}.values() if n in flows.columns]
    test = F.col(BAD_LINE).isNotNull() if BAD_LINE in flows.columns else F.lit(False)
    for name in names:
        test = test | F.col(name).isNull()
    return test


def within_capture(flows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds `day` by file name and keeps flows inside that day's capture.

    A file that the calendar does not know stops the job, which names it.
    The calendar is one row per capture file, a literal table, so Spark
    broadcasts it by its own size estimate.
    """
    unknown = F.raise_error(F.concat(F.lit("not in the capture calendar: "), F.coalesce("file", F.lit("no file"))))
    inside = F.when(F.col("start").isNull(), unknown.cast("boolean")).otherwise(F.col("ts").between(F.col("start"), F.col("end")))
    return (
        flows.join(calendar, "file", "left")
        .filter(inside)
        .drop("start", "end")
    )


def internal_flows(flows: DataFrame, prefix: str | None = None) -> DataFrame:
    """Flows with an internal address on either end."""
    return flows.filter(touches_internal(prefix=prefix) if prefix else touches_internal())
