"""Compares registered queries with their SQL: python tests/check.py [sf] [name ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        return (2, "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, int):
        return (2, repr(float(value)) if abs(value) < 2**53 else str(value))
    return (3, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return False, f"{len(got)} rows vs {len(want)}; extra {extra} missing {missing}"
    return True, f"{len(got)} rows"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from threadlake.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                            "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("CHECK_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["CHECK_TZ"])
    con = connect(sf_dir)
    oracles, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            ok, text = compare(df, con, oracles[name]) if name in oracles else (True, f"{df.count()} rows, no SQL")
        except Exception as exc:  # noqa: BLE001 - a report over all queries
            ok, text = False, "".join(traceback.format_exception_only(exc))[:1500]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {text}", flush=True)
    print(f"{bad} failures")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
