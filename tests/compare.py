"""Run registered queries and compare them with their SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return ("f", round(v, 6))
    if isinstance(v, decimal.Decimal):
        return ("f", round(float(v), 6))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, sf, name, query, sql):
    """(ok, message) of one query."""
    start = time.time()
    df = query(spark, sf)
    got_rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    got = rows_of(df.columns, got_rows)
    if sql is None:
        return bool(got_rows), f"{len(got_rows)} rows, no SQL, {took:.1f}s"
    start = time.time()
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want_rows = rel.fetchall()
    sql_took = time.time() - start
    want = rows_of(columns, want_rows)
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        extra = list((got - want).items())[:2]
        missing = list((want - got).items())[:2]
        return False, f"{len(got_rows)} rows vs {len(want_rows)}\n   spark: {extra}\n   sql:   {missing}"
    return True, f"{len(got_rows)} rows, {took:.1f}s, sql {sql_took:.1f}s"


def main():
    from __spark_entry__ import oracle_sql, queries
    from tests.session import session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = session()
    con = connect(sf)
    names = sys.argv[1:] or list(queries())
    bad = []
    for name in names:
        try:
            ok, message = check(spark, con, sf, name, queries()[name], oracle_sql().get(name))
        except Exception as e:  # report every query
            ok, message = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} ok; failed: {' '.join(bad)}")


if __name__ == "__main__":
    main()
