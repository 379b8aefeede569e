"""Run registered queries and their SQL side by side: ``python tests/compare.py [pattern] [sf]``."""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([repr([norm(r[i]) for i in order]) for r in rows])


def compare(spark, con, name, plan, sql, sf):
    """(ok, message)."""
    start = time.time()
    df = plan(spark, sf)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if not sql:
        return bool(got), f"{spent:5.1f}s rows={len(got)} (rows only)"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} want {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"{spent:5.1f}s rows {len(a)} want {len(b)}; {sorted(cols)} first differences {diff}"
    return bool(got), f"{spent:5.1f}s rows={len(got)}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from fieldhush.session import local_session

    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(sf), oracle_sql()
    bad = 0
    for name, plan in queries().items():
        if not re.search(pattern, name):
            continue
        try:
            ok, msg = compare(spark, con, name, plan, sqls.get(name), sf)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, msg, flush=True)
    print("failed:", bad)
