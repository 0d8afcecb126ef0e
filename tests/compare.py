"""Run registered queries next to their SQL in DuckDB and compare the values.

``python -m tests.compare SF_DIR [name-prefix ...]``
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("0none", "")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, int):
        return ("i", str(v))
    if isinstance(v, (float, decimal.Decimal)):
        return ("f", f"{float(v) + 0.0:.6f}" if v else "0.000000")
    if isinstance(v, (dt.datetime, dt.date)):
        return ("t", str(v))
    return (type(v).__name__, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple(kind(r[i]) for i in order) for r in rows])


def compare(entry, spark, sf_dir: str, con) -> tuple[bool, str]:
    t0 = time.time()
    df = entry.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if entry.sql is None:
        return True, f"rows only {len(got[1])} rows, {t1 - t0:.1f}s"
    cur = con.execute(entry.sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    took = f"{len(got[1])} rows, spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, (
            f"{len(got[1])} vs {len(want[1])} rows\n   spark only {sorted(a - b)[:3]}"
            f"\n   duckdb only {sorted(b - a)[:3]}"
        )
    return True, took


def main(argv):
    from opsweave.plans import load_all
    from opsweave.session import local_session

    sf_dir, prefixes = argv[0], argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = []
    for name, e in load_all().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, msg = compare(e, spark, sf_dir, con)
        except Exception as x:  # report every query, then fail at the end
            ok, msg = False, f"{type(x).__name__}: {str(x)[:600]}"
        print("ok  " if ok else "FAIL", name, msg, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
