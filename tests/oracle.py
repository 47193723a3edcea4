"""Run registered queries beside their SQL and compare every value.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from brushwork.plans import oracle_sql, queries  # noqa: E402
from brushwork.plans.data import TABLES  # noqa: E402


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "float": "FLOAT"}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def key(row):
    return tuple((v is None, type(v).__name__ if not isinstance(v, (int, float)) else "n",
                  ("nan" if isinstance(v, float) and math.isnan(v) else v) if v is not None else 0) for v in row) \
        if not any(isinstance(v, float) and math.isnan(v) for v in row) else tuple((False, "s", str(v)) for v in row)


def compare(spark, con, folder: str, name: str) -> dict:
    t0 = time.time()
    df = queries()[name](spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - t0
    out = {"name": name, "rows": len(got_rows), "seconds": round(seconds, 2)}
    sql = oracle_sql().get(name)
    if sql is None:
        return {**out, "status": "rows-only"}
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want_rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return {**out, "status": f"COLUMNS {sorted(df.columns)} != {sorted(names)}"}
    order = sorted(df.columns)
    pick = lambda cols, rows: [tuple(plain(r[cols.index(c)]) for c in order) for r in rows]
    got = sorted(pick(df.columns, got_rows), key=lambda r: str(r))
    want = sorted(pick(names, want_rows), key=lambda r: str(r))
    if len(got) != len(want):
        return {**out, "status": f"ROWS {len(got)} != {len(want)}"}
    if str(got) != str(want):
        bad = [(g, w) for g, w in zip(got, want) if str(g) != str(w)]
        return {**out, "status": f"VALUES differ in {len(bad)} rows, first {order}: {bad[0]}"}
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    theirs = {c[0]: str(c[1]) for c in cur.description} if cur.description else {}
    return {**out, "status": "ok", "types": (kinds, theirs)}


if __name__ == "__main__":
    from brushwork.session import local_session

    args = [a for a in sys.argv[1:] if a != "--types"]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(cores="8"), connect(folder)
    names = args or list(queries())
    failed = 0
    for n in names:
        try:
            res = compare(spark, con, folder, n)
        except Exception as e:  # report and go on
            res = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:700]}"}
        if res["status"] not in ("ok", "rows-only"):
            failed += 1
        print(f"{res['name']:24} {res.get('rows', '-'):>7} {res.get('seconds', '-'):>7}  {res['status']}", flush=True)
        for column, kind in res.get("types", ({}, {}))[0].items():
            theirs = res["types"][1][column]
            if KINDS.get(kind) != theirs and "--types" in sys.argv:
                print(f"    {column}: {kind} against {theirs}")
    print(f"{len(names)} queries, {failed} failed")
