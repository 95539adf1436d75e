"""Run registered queries next to their SQL and compare the rows.

    python -m checks.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb
from pyspark.sql import SparkSession

from checks.catalogue import ORACLES, QUERIES
from checks.projection import TABLES


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set memory_limit = '8GB'")
    con.execute("set temp_directory = ''")  # a query that needs to spill is written badly
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, bool) or value is None:
        return repr(value)
    return str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    spent = time.time() - started
    if name not in ORACLES:
        return True, f"{len(ours)} rows, no SQL, {spent:.1f}s"
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} and {sorted(columns)}"
    if ours == theirs:
        return True, f"{len(ours)} rows, {spent:.1f}s"
    left, right = set(ours) - set(theirs), set(theirs) - set(ours)
    return False, f"{len(ours)} and {len(theirs)} rows; only Spark {sorted(left)[:2]}; only SQL {sorted(right)[:2]}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark, con = session(), duck(options.sf)
    bad = 0
    for name in options.names or QUERIES:
        try:
            ok, note = compare(spark, con, options.sf, name)
        except Exception as error:  # shown per query, so one failure does not hide the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
