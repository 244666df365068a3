"""Run registered queries on Spark and their SQL twins on DuckDB and compare the rows.

Usage: python -m tests.compare SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from trailmark.catalog import registry


def session(cores: str = "8", **conf) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trailmark")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRAILMARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    """A comparable form of one cell: floats rounded, everything nested turned into tuples."""
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        if math.isnan(number):
            return ("n", "nan")
        return ("n", round(number, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return ("l", tuple(plain(v) for v in value))
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in registry.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    q = registry.load()[name]
    started = time.time()
    df = q.build(registry.Tables(spark, folder))
    got = df.collect()
    took = time.time() - started
    if q.sql is None:
        return True, f"rows-only rows={len(got)} {took:.2f}s"
    result = con.execute(q.sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a != b:
        in_a, in_b = set(a), set(b)
        left = [r for r in a if r not in in_b][:3]
        right = [r for r in b if r not in in_a][:3]
        return False, f"rows {len(a)} vs {len(b)}\n   spark only {left}\n   sql only   {right}"
    return True, f"rows={len(a)} {took:.2f}s" + ("  EMPTY" if not a else "")


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(folder)
    if os.environ.get("TRAILMARK_SPLIT"):
        spark.conf.set("trailmark.blockRows", os.environ["TRAILMARK_SPLIT"])
    failed = 0
    for name in registry.load():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as error:  # report and go on to the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
