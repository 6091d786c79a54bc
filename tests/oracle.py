"""Side-by-side run of the registered queries in Spark and DuckDB."""

import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = normal([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(mine[1]), set(theirs[1])
        return f"rows {len(mine[1])} / {len(theirs[1])}; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
    return None if mine[1] else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    wanted = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    for name in wanted:
        start = time.time()
        try:
            if name in entry.oracle_sql():
                said = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], sf)
            else:
                said = f"rows only: {entry.queries()[name](spark, sf).count()}"
        except Exception as e:  # report and go on with the next query
            said = f"ERROR {str(e)[:600]}"
        print(f"{name}: {said or 'ok'} ({time.time() - start:.1f}s)", flush=True)
