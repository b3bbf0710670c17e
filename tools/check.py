"""Run registered queries beside their SQL twins and report differences.

usage: python tools/check.py [--sf DIR] [--family MODULE] [name ...]
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from lodeworks.plans import FAMILIES, load_catalog  # noqa: E402
from lodeworks.plans.registry import CATALOG  # noqa: E402
from lodeworks.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(r[i] for i in order) for r in rows),
        key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r),
    )


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--family")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    if args.family:
        for fam in args.family.split(","):
            importlib.import_module(f"lodeworks.plans.{fam}")
        catalog = CATALOG
    else:
        catalog = load_catalog()
    assert FAMILIES
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{args.sf}/{t}.parquet'")
    spark = local_session("8", "check")
    bad = 0
    for name, q in catalog.items():
        if args.names and name not in args.names:
            continue
        try:
            t0 = time.time()
            df = q.build(spark, args.sf)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR spark {name}: {str(e)[:900]}")
            continue
        if q.sql is None:
            print(f"rows  {name}: {len(got)} rows {t1 - t0:.2f}s")
            continue
        try:
            cur = db.execute(q.sql)
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR sql {name}: {str(e)[:900]}")
            continue
        if sorted(cols) != sorted(df.columns):
            bad += 1
            print(f"FAIL  {name}: columns {sorted(df.columns)} vs {sorted(cols)}")
            continue
        a, b = rows_of(df.columns, got), rows_of(cols, want)
        if a == b and repr(a) == repr(b):
            flag = "ok   " if got else "EMPTY"
            bad += not got
            print(f"{flag} {name}: {len(a)} rows, spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s")
        else:
            bad += 1
            print(f"FAIL  {name}: {len(a)} vs {len(b)} rows; columns {sorted(cols)}")
            sb, sa = set(map(repr, b)), set(map(repr, a))
            for x in [x for x in a if repr(x) not in sb][:3]:
                print("   spark only:", str(x)[:600])
            for x in [x for x in b if repr(x) not in sa][:3]:
                print("   sql only:  ", str(x)[:600])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
