"""Runs registered queries in Spark and their SQL in DuckDB and compares the results.

python tests/compare.py <folder> [name or prefix* ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, int) or type(value).__name__.startswith("int"):
        return str(int(value))
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, queries, oracles, verbose=True):
    start = time.time()
    df = queries[name](spark, folder)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in oracles:
        print(f"no SQL {name} {len(got)} rows {took:.1f}s", flush=True)
        return False
    res = con.execute(oracles[name])
    want_cols, want = normal([c[0] for c in res.description], res.fetchall())
    ok = got_cols == want_cols and got == want
    print(f"{'ok  ' if ok else 'DIFF'} {name} {len(got)}/{len(want)} {took:.1f}s "
          f"duck {time.time() - start - took:.1f}s", flush=True)
    if not ok and verbose:
        print("  cols", got_cols, want_cols)
        a, b = set(got), set(want)
        print("  spark only", len(a - b), sorted(a - b)[:3])
        print("  duck only ", len(b - a), sorted(b - a)[:3], flush=True)
    return ok


if __name__ == "__main__":
    import __spark_entry__ as entry
    from orderlens.session import session
    folder, names = sys.argv[1], sys.argv[2:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = session("local[8]", shuffle_partitions=8)
    con = duck(folder)
    picked = [n for n in queries if not names or any(
        n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in names)]
    bad = []
    for n in picked:
        try:
            if not compare(spark, con, folder, n, queries, oracles):
                bad.append(n)
        except Exception as exc:
            print(f"FAIL {n} {type(exc).__name__}: {str(exc)[:900]}", flush=True)
            bad.append(n)
    print(len(picked) - len(bad), "good; bad:", bad)
