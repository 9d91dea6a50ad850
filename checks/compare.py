"""Runs registered queries next to their SQL statements and compares the rows.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    return round(v, 9) if isinstance(v, float) else v


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda t: tuple(str(x) for x in t))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark: SparkSession, con, sf: str, name: str) -> tuple[bool, str]:
    began = time.time()
    df = QUERIES[name](spark, sf)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    mid = time.time()
    if name not in ORACLES:
        return True, f"{len(got)} rows (no SQL) spark {mid - began:.1f}s"
    cur = con.execute(ORACLES[name])
    want_names = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), want_names)
    took = f"spark {mid - began:.1f}s sql {time.time() - mid:.1f}s"
    if sorted(df.columns) != sorted(want_names):
        return False, f"columns {sorted(df.columns)} <> {sorted(want_names)}"
    if got != want:
        have, need = set(got), set(want)
        extra = [r for r in got if r not in need][:3]
        lack = [r for r in want if r not in have][:3]
        return False, f"rows {len(got)} <> {len(want)}; extra {extra}; missing {lack}; {took}"
    return True, f"{len(got)} rows {took}"


def main() -> None:
    sf = sys.argv[1]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", os.environ.get("CHECK_DIR", "/tmp/gainsay-checkpoints")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        try:
            ok, text = compare(spark, con, sf, name)
        except Exception as e:  # noqa: BLE001 - reported per query
            ok, text = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, text, flush=True)
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
