"""Run registered queries on Spark and DuckDB and compare: python tools/check_oracle.py [sf] [name-part …]."""

from __future__ import annotations

import decimal
import importlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def main() -> int:
    from cloakwork import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                           "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    if parts and parts[0].startswith("mod:"):
        todo = importlib.import_module(f"catalog.{parts[0][4:]}").QUERIES
        parts = parts[1:]
    else:
        from catalog import all_queries
        todo = all_queries()
    bad = 0
    for q in todo:
        if parts and not any(p in q.name for p in parts):
            continue
        t0 = time.time()
        try:
            df = q.call(spark, sf_dir)
            got = table(df.columns, df.collect())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {q.name}: spark {type(e).__name__}: {str(e)[:600]}", flush=True)
            bad += 1
            continue
        took = time.time() - t0
        if not q.sql:
            print(f"rows  {q.name}: {len(got[1])} rows {took:.1f}s", flush=True)
            continue
        try:
            r = con.execute(q.sql)
            want = table([d[0] for d in r.description], r.fetchall())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {q.name}: duckdb {type(e).__name__}: {str(e)[:600]}", flush=True)
            bad += 1
            continue
        if got == want:
            print(f"ok    {q.name}: {len(got[1])} rows {took:.1f}s", flush=True)
        else:
            bad += 1
            a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
            print(f"DIFF  {q.name}: spark {len(got[1])} duckdb {len(want[1])} cols {got[0]} {want[0]}\n"
                  f"      spark only {[str(x)[:200] for x in sorted(a)[:3]]}\n      duck only {[str(x)[:200] for x in sorted(b)[:3]]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
