"""Compare registered queries with their SQL twins: ``python tests/twin.py [sf] [names...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


def connect(sf_dir: str):
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str) -> tuple[bool, str]:
    """(equal, what differs) of one query at one scale."""
    from catalog import QUERIES, SQL

    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if name not in SQL:
        return sum(got.values()) > 0, f"{sum(got.values())} rows, no twin, {took:.1f}s"
    started = time.time()
    cursor = connection.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    twin_took = time.time() - started
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {df.columns} and {columns}"
    note = f"{sum(got.values())} rows, {took:.1f}s, twin {twin_took:.1f}s"
    if got == expected:
        return True, note
    extra, missing = got - expected, expected - got
    sample = f"{list(extra)[:2]} against {list(missing)[:2]}"
    return False, f"{note}; {sum(extra.values())} extra, {sum(missing.values())} missing: {sample[:900]}"


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillmill-tests-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from catalog import QUERIES

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{scale}"
    spark, connection = session(), connect(folder)
    failed = []
    for name in sys.argv[2:] or QUERIES:
        try:
            equal, note = compare(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001
            equal, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += [] if equal else [name]
        print("ok  " if equal else "FAIL", name, note, flush=True)
    print(len(failed), "failed:", failed)
