"""Small dimension tables: capture calendar, ground truth, static port lists."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

# Capture files in day order. A capture runs from 04:00 to 04:00 of the next day.
CAPTURE_FILES = [
    ("14-02-18_ftp_bruteforce_partial.csv", 1, "2018-02-14"),
    ("new_wednesday-14-02-18.csv", 1, "2018-02-14"),
    ("new_thursday-15-02-18.csv", 2, "2018-02-15"),
    ("new_friday-16-02-18.csv", 3, "2018-02-16"),
    ("new_tuesday-20-02-18.csv", 4, "2018-02-20"),
    ("new_wednesday-21-02-18.csv", 5, "2018-02-21"),
    ("new_thursday-22-02-18.csv", 6, "2018-02-22"),
    ("new_friday-23-02-18.csv", 7, "2018-02-23"),
    ("new_wednesday-28-02-18.csv", 8, "2018-02-28"),
    ("new_thursday-01-03-18.csv", 9, "2018-03-01"),
    ("new_friday-02-03-18.csv", 10, "2018-03-02"),
]
CAPTURE_START_HOUR = 4

# Attacked machines, by day.
VICTIMS = {
    1: ["172.31.69.25", "18.217.21.148"],
    2: ["172.31.69.25", "18.217.21.148"],
    3: ["172.31.69.25", "18.217.21.148"],
    4: ["172.31.69.25", "18.217.21.148"],
    5: ["172.31.69.28", "18.218.83.150"],
    6: ["172.31.69.28", "18.218.83.150"],
    7: ["172.31.69.28", "18.218.83.150"],
    8: ["172.31.69.24", "18.221.148.137"],
    9: ["172.31.69.13", "18.216.254.154"],
    10: [
        "172.31.69.23", "18.217.218.111", "172.31.69.17", "18.222.10.237", "172.31.69.14",
        "18.222.86.193", "172.31.69.12", "18.222.62.221", "172.31.69.10", "13.59.9.106",
        "172.31.69.8", "18.222.102.2", "172.31.69.6", "18.219.212.0", "172.31.69.26",
        "18.216.105.13", "172.31.69.29", "18.219.163.126", "172.31.69.30", "18.216.164.12",
    ],
}

# Attacking machines, by day.
ATTACKERS = {
    1: ["18.221.219.4", "13.58.98.64"],
    2: ["18.219.211.138", "18.217.165.70"],
    3: ["13.59.126.31", "18.219.193.20"],
    4: [
        "18.218.115.60", "18.219.9.1", "18.219.32.43", "18.218.55.126", "52.14.136.135",
        "18.219.5.43", "18.216.200.189", "18.218.229.235", "18.218.11.51", "18.216.24.42",
    ],
    5: [
        "18.218.115.60", "18.219.9.1", "18.219.32.43", "18.218.55.126", "52.14.136.135",
        "18.219.5.43", "18.216.200.189", "18.218.229.235", "18.218.11.51", "18.216.24.42",
    ],
    6: ["18.218.115.60"],
    7: ["18.218.115.60"],
    8: ["13.58.225.34"],
    9: ["13.58.225.34"],
    10: ["18.219.211.138"],
}

# The static port lists of methods 0 and 2.
STATIC_PORTS = {0: [80, 194, 25, 22], 2: [80, 194, 25, 22, 6667]}


def capture_calendar(spark: SparkSession, files=None) -> DataFrame:
    """(file, day, start, end); both bounds belong to the capture."""
    rows = []
    for name, day, date in files or CAPTURE_FILES:
        start = datetime.fromisoformat(date) + timedelta(hours=CAPTURE_START_HOUR)
        rows.append((name, day, start, start + timedelta(days=1)))
    return spark.createDataFrame(rows, "file string, day int, start timestamp_ntz, end timestamp_ntz")


def capture_origins(files=None) -> dict[int, int]:
    """day -> the midnight at which its capture day begins, in seconds after midnight 1970-01-01.

    As `origin` of the windows, every day's grid begins at its own midnight, also
    for lengths that do not divide a day.
    """
    return {day: int((datetime.fromisoformat(date) - datetime(1970, 1, 1)).total_seconds()) for _, day, date in files or CAPTURE_FILES}


def ground_truth(spark: SparkSession) -> DataFrame:
    """(day, role, ip) of the known victims and attackers."""
    rows = [
        (day, role, ip)
        for role, days in (("victim", VICTIMS), ("attacker", ATTACKERS))
        for day, ips in days.items()
        for ip in ips
    ]
    return spark.createDataFrame(rows, "day int, role string, ip string")
