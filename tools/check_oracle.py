"""Run every catalog query in Spark and its SQL twin in DuckDB; compare.

Usage: python tools/check_oracle.py [sf_dir] [key ...]
Prints one line per query: OK / MISMATCH / ROWS-ONLY / ERROR.
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from issuelens.plans.catalog import entries  # noqa: E402
from issuelens.session import build_session  # noqa: E402
from issuelens.sources.tables import TABLES, table_path  # noqa: E402


TYPE_NAMES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
              "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT"}


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def main(argv):
    sf = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in argv if not a.startswith("/")]
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{table_path(sf, t)}')")
    bad = 0
    for key, e in sorted(entries().items()):
        if keys and key not in keys:
            continue
        t0 = time.time()
        try:
            sdf = e.query(spark, sf)
            scols = sdf.columns
            srows = sdf.collect()
            ts = time.time() - t0
            if e.sql is None:
                print(f"ROWS-ONLY {key:28s} rows={len(srows)} {ts:.1f}s", flush=True)
                continue
            rel = con.sql(e.sql)
            dcols, dtypes = rel.columns, [str(t) for t in rel.types]
            drows = rel.fetchall()
            problems = []
            if sorted(scols) != sorted(dcols):
                problems.append(f"cols spark={sorted(scols)} sql={sorted(dcols)}")
            stypes = {f.name: TYPE_NAMES.get(repr(f.dataType), repr(f.dataType)) for f in sdf.schema.fields}
            tdiff = {k: (stypes.get(k), t) for k, t in zip(dcols, dtypes) if stypes.get(k) != t}
            if tdiff:
                problems.append(f"types {tdiff}")
            if len(srows) != len(drows):
                problems.append(f"rows spark={len(srows)} sql={len(drows)}")
            if not problems:
                a, b = rows_of(scols, srows), rows_of(dcols, drows)
                if a != b:
                    only_s = list((a - b).items())[:3]
                    only_d = list((b - a).items())[:3]
                    problems.append(f"values differ: spark-only={only_s} sql-only={only_d}")
            if problems:
                bad += 1
                print(f"MISMATCH  {key:28s} " + " | ".join(problems)[:3000], flush=True)
            else:
                print(f"OK        {key:28s} rows={len(srows)} {ts:.1f}s", flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"ERROR     {key:28s} {type(exc).__name__}: {str(exc)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"done, {bad} problem(s)")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
