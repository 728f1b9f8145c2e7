"""Runs named queries on Spark and their SQL on DuckDB and compares the results.

Usage: python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    return v


def kind(t: str) -> str:
    t = t.lower()
    for names, k in ((("bigint", "long"), "i64"), (("integer", "int"), "i32"), (("smallint",), "i16"), (("double",), "f64"),
                     (("float",), "f32"), (("varchar", "string"), "str"), (("boolean", "bool"), "bool"),
                     (("timestamp_ntz", "timestamp"), "ts"), (("date",), "date")):
        if t in names:
            return k
    return t


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return con


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    theirs = dict(zip(rel.columns, [str(t) for t in rel.types]))
    ours = dict(df.dtypes)
    notes = [f"{c}:{ours[c]}/{theirs[c]}" for c in cols if kind(ours[c]) != kind(theirs[c])]
    left = Counter(tuple(cell(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    right = Counter(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    if left != right:
        a, b = list((left - right).items())[:3], list((right - left).items())[:3]
        return f"{sum(left.values())} vs {sum(right.values())} rows over {cols}; only spark {str(a)[:900]}; only sql {str(b)[:900]}"
    return ("types " + ",".join(notes)) if notes else None


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("names", nargs="*")
    args.add_argument("--sf", default="0.01")
    args.add_argument("--skip", nargs="*", default=[])
    opts = args.parse_args()
    import __spark_entry__ as entry
    from trialmesh.session import build_session
    spark = build_session("check", "local[8]", 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{opts.sf}"
    con, sql, bad = duck(folder), entry.oracle_sql(), 0
    every = entry.queries()
    for name in [n for n in every if not opts.names or any(n == w or n.startswith(w.rstrip("*")) and w.endswith("*") for w in opts.names)]:
        if name in opts.skip:
            continue
        start = time.time()
        try:
            df = every[name](spark, folder)
            if name in sql:
                result = compare(df, con, sql[name])
            else:
                n = df.count()
                result = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - start
        bad += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {took:.1f}s {'' if name in sql else '(rows)'} {result or ''}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
