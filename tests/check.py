"""Run registered queries in Spark and their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str, make, sql: str) -> str | None:
    """None when both results are equal, else what differs."""
    df = make(spark, folder)
    left = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} / {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows / {len(right[1])} rows"
    odd = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(odd)} of {len(left[1])} rows differ, first {odd[0]}" if odd else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1]
    names = sys.argv[2:] or list(queries())
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false") \
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g") \
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="check-")) \
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names:
        if name not in oracle_sql():
            continue
        t = time.time()
        try:
            problem = compare(spark, con, folder, name, queries()[name], oracle_sql()[name])
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name:24s} {time.time() - t:6.2f}s {problem or 'ok'}", flush=True)
