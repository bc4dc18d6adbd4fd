"""Run registered queries in Spark and their oracle SQL in DuckDB; compare as multisets.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tagflow.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, round(v, 6))
    if isinstance(v, bool):
        return (2, int(v))
    if isinstance(v, int):
        return (1, float(v))
    if isinstance(v, (list, tuple)):
        return (3, tuple(norm(x) for x in v))
    return (4, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(cols)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from tagflow.session import get_session

    spark = get_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    ok = bad = 0
    for name in (names or sorted(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            dcols, drows = duck(sf_dir, sqls[name])
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        a, ac = rows_of(scols, srows)
        b, bc = rows_of(dcols, drows)
        if ac != bc:
            print(f"FAIL {name}: columns {ac} vs {bc}")
            bad += 1
        elif a != b:
            diff = [x for x in a if x not in b][:3]
            diff2 = [x for x in b if x not in a][:3]
            print(f"FAIL {name}: rows spark={len(a)} duck={len(b)} spark-only={diff} duck-only={diff2}")
            bad += 1
        else:
            print(f"OK   {name}: {len(a)} rows {ts:.1f}s")
            ok += 1
    print(f"ok={ok} bad={bad}")
    spark.stop()


if __name__ == "__main__":
    main()
