"""Run queries and their SQL side by side: ``python -m checks.compare [sf_dir] [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def test_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("CHECKS_DIR", "/tmp/checkpoints"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    found = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(found, key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    spent = time.time() - start
    if name not in ORACLES:
        return len(got) > 0, f"{len(got)} rows (rows only) {spent:.2f}s"
    sql = ORACLES[name]
    cur = con.execute(sql() if callable(sql) else sql)
    names = [d[0] for d in cur.description]
    want_names, want = rows_of(names, cur.fetchall())
    names, have = rows_of(df.columns, got)
    note = f"{len(have)} rows {spent:.2f}s"
    if names != want_names:
        return False, f"columns {names} vs {want_names}"
    if have != want:
        diff = [(a, b) for a, b in zip(have, want) if a != b][:2]
        return False, f"{len(have)} vs {len(want)} rows; first differences {str(diff)[:1500]}"
    return True, note


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con, bad = test_session(), oracle(sf_dir), 0
    for name in argv[1:] or QUERIES:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
