"""Compare registered queries with their SQL in DuckDB: python tests/oracle_check.py [sf] [name-part ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from mastwire.plans.adapters import TABLES


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 4) + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    if type(value).__name__ == "Decimal":
        return round(float(value), 4)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def close(a, b):
    if a == b:
        return True
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-4)
    return False


def compare(spark, con, folder, name, function, sql):
    frame = function(spark, folder)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return f"rows only: {len(got)}", len(got) > 0
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns differ: {sorted(frame.columns)} != {sorted(names)}", False
    if len(got) != len(want):
        return f"rows differ: spark {len(got)}, sql {len(want)}", False
    exact = sum(g == w for g, w in zip(got, want))
    if exact == len(got):
        return f"ok {len(got)}", True
    bad = [(g, w) for g, w in zip(got, want) if not all(close(a, b) for a, b in zip(g, w))]
    if bad:
        return f"values differ in {len(bad)} of {len(got)}; first {sorted(names)}: {bad[0]}", False
    return f"ok within rounding {len(got)} ({len(got) - exact} not exact)", True


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    from mastwire.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, function in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            text, good = compare(spark, con, folder, name, function, oracles.get(name))
        except Exception as error:
            if os.environ.get("TRACE"):
                traceback.print_exc()
            text, good = f"{type(error).__name__}: {str(error)[:700]}", False
        failed += not good
        print(f"{'PASS' if good else 'FAIL'} {time.time() - start:6.1f}s {name}: {text}", flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()
