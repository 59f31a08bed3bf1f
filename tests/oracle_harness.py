"""Run registered queries in Spark and their DuckDB twins; compare results.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive value multiset
(floats rounded to 6 decimals).
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from basketry.sources.tables import TABLE_NAMES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'") if False else None
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm_value(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return norm_value(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm_value(x) for x in v)
    if hasattr(v, "tolist"):
        return norm_value(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, norm_value(x)) for k, x in v.items()))
    return v


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in records:
        out.append(tuple(norm_value(r[i]) for i in order))
    return sorted(out, key=repr), [columns[i] for i in order]


def compare(name, spark, con, sf_dir, fn, sql):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    scols = sdf.columns
    res = {"name": name, "spark_sec": round(t1 - t0, 2), "spark_rows": len(srows)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["duck_rows"] = len(drows)
    a, ac = rows_of(scols, srows)
    b, bc = rows_of(dcols, drows)
    if ac != bc:
        res["status"] = f"COLUMNS spark={ac} duck={bc}"
    elif len(a) != len(b):
        res["status"] = "ROWCOUNT"
    elif a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"VALUES {diff}"
    else:
        res["status"] = "OK"
    return res


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir = args.pop(0)
    import __spark_entry__ as entry
    from basketry.session import build_session
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs = entry.queries()
    oracle = entry.oracle_sql()
    names = args or list(qs)
    bad = 0
    for name in names:
        try:
            r = compare(name, spark, con, sf_dir, qs[name], oracle.get(name))
        except Exception as exc:  # report and continue
            r = {"name": name, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if r["status"] not in ("OK", "rows-only"):
            bad += 1
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
