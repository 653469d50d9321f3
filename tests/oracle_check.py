"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

    python tests/oracle_check.py [sf_dir] [name ...]

Row count, column names and the sorted multiset of rows must agree.
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(records) -> list[tuple]:
    out = [tuple(_norm(x) for x in r) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    srows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"rows-only {len(srows)} rows, spark {t1 - t0:.1f}s"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(dcols):
        return False, f"columns differ: spark-only {sorted(set(cols) - set(dcols))} duck-only {sorted(set(dcols) - set(cols))}"
    order = sorted(cols)
    si = [cols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    a = rows_of([tuple(r[i] for i in si) for r in srows])
    b = rows_of([tuple(r[i] for i in di) for r in drows])
    if len(a) != len(b):
        return False, f"row count spark {len(a)} duck {len(b)}"
    if a != b:
        for x, y in zip(a, b):
            if x != y:
                diff = [(order[i], x[i], y[i]) for i in range(len(order)) if x[i] != y[i]]
                return False, f"value mismatch, first differing row: {diff[:6]}"
    return True, f"{len(a)} rows x {len(cols)} cols, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as entry
    from clickfeat.session import get_spark
    spark = get_spark("local[8]", 8)
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        try:
            ok, msg = compare(spark, con, name, qs[name], sqls.get(name), sf_dir)
        except Exception as exc:  # report and go on
            ok, msg = False, f"error: {type(exc).__name__}: {str(exc)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name}: {msg}", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
