"""Reading flow records and feature tables."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Column names of the flow files, with our names and types.
RAW_COLUMNS = {
    "Timestamp": ("ts", "timestamp_ntz"),
    "Src IP": ("src_ip", "string"),
    "Dst IP": ("dst_ip", "string"),
    "Src Port": ("src_port", "int"),
    "Dst Port": ("dst_port", "int"),
    "Tot Fwd Pkts": ("fwd_pkts", "bigint"),
    "Tot Bwd Pkts": ("bwd_pkts", "bigint"),
    "TotLen Fwd Pkts": ("fwd_bytes", "double"),
    "TotLen Bwd Pkts": ("bwd_bytes", "double"),
}
RATE_COLUMNS = {
    "SYN Flag Cnt": ("syn_cnt", "double"),
    "Flow Duration": ("flow_duration", "double"),
    "Protocol": ("protocol", "int"),
}

#: Holds the text of lines with too many or too few cells.
BAD_LINE = "bad_line"


def header_catalogue(spark: SparkSession, path) -> dict[tuple[str, ...], list[str]]:
    """header -> the files that have it. Of every file the first line is read; empty files are left out."""
    files = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in spark.read.text(path).inputFiles()]
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: tuple(spark.read.option("header", True).csv(f).columns), files))
    found: dict[tuple[str, ...], list[str]] = {}
    for header, file in sorted(zip(headers, files)):
        if header:
            found.setdefault(header, []).append(file)
    return found


def read_flow_csv(spark: SparkSession, path, columns=None, keep_lines: bool = False) -> DataFrame:
    """Raw flows as text, plus the name of the file each row came from.

    A CSV scan with a given schema matches by position, so files are grouped by their
    headers and each group is one scan under its own. Files may differ in the order of
    their columns and have others besides. A rate column that only some files have is
    null in the others; a file without one of the other columns stops the read.

    Of a line with too many cells the last ones are left out, and where cells lack they are
    null. With `keep_lines`, `bad_line` has the text of such lines and is null for all others.
    """
    catalogue = header_catalogue(spark, path)
    if not catalogue:
        raise ValueError(f"no flow file with a header in {path}")
    wanted = columns or [*RAW_COLUMNS, *(c for c in RATE_COLUMNS if any(c in header for header in catalogue))]
    scans = []
    for header, files in catalogue.items():
        lacking = [c for c in wanted if c not in header and c not in RATE_COLUMNS]
        if lacking:
            raise ValueError(f"{files[0]} has no column {', '.join(lacking)}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        reader = spark.read.option("header", True).option("enforceSchema", False)
        if keep_lines:
            schema.add(BAD_LINE, T.StringType())
            # lines are only counted against the whole header where every column is read
            reader = reader.option("columnNameOfCorruptRecord", BAD_LINE).option("columnPruning", False)
        raw = reader.schema(schema).csv(files)
        cells = [F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in wanted]
        if keep_lines:
            cells.append(F.col(BAD_LINE))
        scans.append(raw.select(*cells, F.col("_metadata.file_name").alias("file")))
    return reduce(DataFrame.unionByName, scans)


def read_flow_parquet(spark: SparkSession, path, calendar: DataFrame | None = None) -> DataFrame:
    """Flows already stored under our names and types (see `sinks.write_flows`).

    With a filtered `calendar` only the folders of its days are read: the days reach
    the scan as a filter on partitions while the job runs.
    """
    flows = spark.read.parquet(path)
    return flows if calendar is None else flows.join(calendar.select("day").distinct(), "day", "left_semi")


FEATURE_KEYS = ("win_start", "view", "role", "file")


def read_feature_csv(spark: SparkSession, path, keys=FEATURE_KEYS) -> DataFrame:
    """Feature matrices written as CSV: entity first, then one column per feature.

    Every file is read by its own header, so files may differ in the order and in the
    set of their columns; a feature that a file lacks is 0. The first column has no name
    or is called entity. Port features may carry a leading `T`, which is stripped.
    Columns named in `keys`, and those of partition folders, are kept as they are.
    """
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    cells = F.split("value", ",", -1)
    lines = lines.select(*folders, cells.alias("cells"), F.col("_metadata.file_path").alias("path"))
    is_header = F.trim(F.get("cells", F.lit(0)), F.lit('"')).isin("", "entity", "Unnamed: 0")
    plain = F.transform("cells", lambda c: F.regexp_replace(F.trim(c, F.lit('"')), "^T(?=[0-9])", ""))
    headers = lines.filter(is_header).select("path", plain.alias("names")).distinct()
    rows = lines.filter(~is_header).join(headers, "path").withColumn("by_name", F.map_from_arrays(F.slice("names", 2, 100_000), F.slice(plain, 2, 100_000)))
    # as many names as there are features, whatever the number of files
    places = headers.select(F.posexplode(F.slice("names", 2, 100_000)).alias("place", "name"))
    names = [r["name"] for r in places.groupBy("name").agg(F.min("place").alias("place")).orderBy("place", "name").collect()]
    value = {}
    for n in names:
        found = F.try_element_at("by_name", F.lit(n))
        value[n] = found if n in keys else F.coalesce(F.when(found != "", found).cast("double"), F.lit(0.0))
    return rows.select(F.get(plain, F.lit(0)).alias("entity"), *folders, *(v.alias(n) for n, v in value.items()))
