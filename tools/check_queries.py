"""Run registered queries on Spark and on DuckDB and compare the rows.

usage: python tools/check_queries.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from leadloom.plans import catalog
from leadloom.session import get_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.6f}"
    if isinstance(v, int):
        return f"{v:.6f}" if False else str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = get_session("check", 8, 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    bad = []
    for name, fn in catalog.QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            sql = catalog.ORACLES.get(name)
            if sql is None:
                print(f"rows  {name:38s} {len(got):7d} rows {spent:6.2f}s")
                if not got:
                    bad.append(name)
                continue
            rel = con.execute(sql)
            cols = [d[0] for d in rel.description]
            want = rel.fetchall()
            if sorted(cols) != sorted(df.columns):
                print(f"COLS  {name} spark={sorted(df.columns)} duckdb={sorted(cols)}")
                bad.append(name)
                continue
            a, b = rows_of(df.columns, got), rows_of(cols, want)
            distinct = len(set(a))
            if a == b and a:
                print(f"ok    {name:38s} {len(got):7d} rows {distinct:7d} distinct {spent:6.2f}s")
            else:
                bad.append(name)
                print(f"DIFF  {name:38s} spark {len(a)} duckdb {len(b)}")
                sa, sb = set(a), set(b)
                print("   columns", sorted(df.columns))
                for x in sorted(sa - sb)[:3]:
                    print("   spark only ", str(x)[:400])
                for x in sorted(sb - sa)[:3]:
                    print("   duckdb only", str(x)[:400])
        except Exception as exc:  # report and go on with the next query
            bad.append(name)
            print(f"ERROR {name}: {str(exc)[:1500]}")
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("failing:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
