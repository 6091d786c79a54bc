"""Flow-shaped views over the driver tables, for queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Runs unchanged in Spark SQL and in DuckDB.
FLOW_SQL = """
SELECT CAST(EXTRACT(day FROM ts) AS INT) AS day, ts,
 CASE WHEN event_id % 5 <= 2 THEN int_ip ELSE ext_ip END AS src_ip,
 CASE WHEN event_id % 5 <= 2 THEN ext_ip WHEN event_id % 5 = 3 THEN int_ip ELSE '8.8.4.4' END AS dst_ip,
 CAST(CASE WHEN event_id % 10 = 0 THEN 443 ELSE 1024 + (event_id * 7919) % 60000 END AS INT) AS src_port,
 CAST(CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'signup' THEN 22
      WHEN 'purchase' THEN 53 ELSE (event_id * 97) % 50000 END AS INT) AS dst_port,
 CAST(CASE WHEN event_id % 17 = 0 THEN 1 ELSE 6 END AS INT) AS protocol,
 CAST((event_id * 17) % 1000 AS DOUBLE) AS flow_duration,
 1 + event_id % 13 AS fwd_pkts, event_id % 7 AS bwd_pkts,
 CAST(ROUND(value * 100) AS DOUBLE) AS fwd_bytes, CAST((event_id * 13) % 1500 AS DOUBLE) AS bwd_bytes,
 CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS syn_cnt,
 event_id
FROM (SELECT *,
  '172.31.' || CAST(64 + user_id % 4 AS STRING) || '.' || CAST(user_id % 251 AS STRING) AS int_ip,
  '18.221.' || CAST((event_id * 7 + user_id) % 61 AS STRING) || '.4' AS ext_ip FROM events) e
"""

# Bulk flows from order lines: no event times, so one window per ship date.
BULK_SQL = """
SELECT CAST(year(l_shipdate) AS INT) AS day, CAST(l_shipdate AS TIMESTAMP) AS ts,
 CASE WHEN l_orderkey % 3 = 0 THEN '9.9.' || CAST(l_suppkey % 200 AS STRING) || '.1'
      ELSE '172.31.' || CAST(64 + l_suppkey % 4 AS STRING) || '.' || CAST(l_suppkey % 251 AS STRING) END AS src_ip,
 '18.221.' || CAST(l_orderkey % 61 AS STRING) || '.' || CAST(l_orderkey % 251 AS STRING) AS dst_ip,
 CAST(l_partkey % 60000 AS INT) AS src_port, CAST((l_partkey * 7) % 1500 AS INT) AS dst_port,
 CAST(6 AS INT) AS protocol, CAST(l_linenumber AS DOUBLE) AS flow_duration,
 CAST(l_quantity AS BIGINT) AS fwd_pkts, CAST(l_linenumber AS BIGINT) AS bwd_pkts,
 CAST(ROUND(l_extendedprice) AS DOUBLE) AS fwd_bytes, CAST(l_suppkey % 1500 AS DOUBLE) AS bwd_bytes,
 CAST(l_linenumber % 2 AS DOUBLE) AS syn_cnt
FROM lineitem
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows derived from `events`; `day` is the day of the month."""
    return spark.sql(FLOW_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def bulk_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows derived from `lineitem`, for volume."""
    return spark.sql(BULK_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
