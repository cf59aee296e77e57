"""Run registered queries next to their SQL twins in DuckDB and report differences.

usage: python scripts/check.py [--sf 0.01] [name ...]
"""

import argparse
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from vayuspark.catalog import ORACLES, QUERIES  # noqa: E402
from vayuspark.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(row[i]) for i in order) for row in data)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    picked = [n for n in QUERIES if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    bad = []
    for name in picked:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = rows(df.columns, df.collect())
            t1 = time.time()
            if name not in ORACLES:
                print(f"rows  {name:34} rows={sum(got[1].values()):8} {t1 - t0:6.1f}s", flush=True)
                continue
            rel = con.sql(ORACLES[name])
            want = rows(rel.columns, rel.fetchall())
            types = dict(zip(rel.columns, map(str, rel.types)))
        except Exception as exc:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
            continue
        ok = got == want
        print(
            f"{'ok   ' if ok else 'DIFF '} {name:34} rows={sum(got[1].values()):8}/{sum(want[1].values()):8} "
            f"spark={t1 - t0:5.1f}s duck={time.time() - t1:5.1f}s", flush=True,
        )
        if not sum(want[1].values()):
            print("   EMPTY", flush=True)
        spark_types = dict(df.dtypes)
        pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}
        off = {c: (t, types.get(c)) for c, t in spark_types.items() if pairs.get(t, types.get(c)) != types.get(c)}
        if off:
            print("   types", off, flush=True)
        if not ok:
            bad.append(name)
            print("   columns", got[0], want[0])
            for side, extra in (("spark", got[1] - want[1]), ("sql", want[1] - got[1])):
                print("  ", side, sum(extra.values()), list(extra.items())[:4])
    print("failed:", bad)


if __name__ == "__main__":
    main()
