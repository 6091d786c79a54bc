"""Writing features, labels, profiles and scores, keyed by day and window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import label_time

LABEL_OFFSET_HOURS = 4


def with_label(df: DataFrame, hours: int = LABEL_OFFSET_HOURS) -> DataFrame:
    """Adds `window`, the window start in label time, date included."""
    return df.withColumn("window", F.date_format(label_time(F.col("win_start"), hours), "yyyy-MM-dd_HH_mm_ss"))


def _save(df: DataFrame, path: str, by, fmt: str, mode: str) -> None:
    # rows of one partition folder stay in as few tasks as their size allows; overwriting replaces the folders written, no others
    first = ["entity"] if "entity" in df.columns else []
    df = df.select(*first, *(c for c in df.columns if c not in first))
    writer = df.hint("rebalance", *by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def write_flows(flows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Typed flows of capture days, one folder per day, so that later jobs parse no text and read their days only."""
    _save(flows, path, ["day"], "parquet", mode)


def write_quarantine(rows: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Rows that are no flows (see `clean.quarantine`), one folder per file they came from."""
    _save(rows.withColumn("unreadable", F.concat_ws(",", "unreadable")), path, ["file"], fmt, mode)


def write_features(features: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", hours: int = LABEL_OFFSET_HOURS) -> None:
    """Wide features (see `features.wide`) or profiles, one folder per day and window.

    CSV has no maps, so profiles are written in wide form there.
    """
    _save(with_label(features, hours), path, ["day", "win_sec", "window"], fmt, mode)


def write_labels(labels: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """(keys, entity, algorithm, cluster), one folder per day, window, view and algorithm."""
    _save(with_label(labels), path, ["day", "win_sec", "window", "view", "algorithm"], fmt, mode)


def write_labelled(found: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Known entities with their clusters (see `outliers.labelled_clusters`)."""
    _save(with_label(found), path, ["day", "win_sec", "role"], fmt, mode)


def write_profiles(profiles: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Mean scaled feature by cluster, under its name if the profile has it (see `kmeans.cluster_profile`)."""
    _save(with_label(profiles), path, ["day", "win_sec", "view"], fmt, mode)


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Scores of all windows, one folder per role."""
    _save(with_label(scores), path, ["role"], fmt, mode)
