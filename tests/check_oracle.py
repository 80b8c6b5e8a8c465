"""Compare registered queries with their DuckDB oracles.

    python tests/check_oracle.py [--sf 0.01] [--blocks N] [name ...]

``--blocks`` forces the split path of ordered operators with blocks of N rows.
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def norm(v):
    import datetime
    import decimal

    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(cols, data):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in at) for r in data]
    return sorted(cols), sorted(out, key=repr)


def same(a, b, tol):
    if a == b and type(a) is not bool and type(b) is not bool or a is b:
        return True
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and tol:
        if isinstance(a, bool) != isinstance(b, bool):
            return False
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def compare(got, want):
    (gc, gr), (wc, wr) = got, want
    if gc != wc:
        return f"columns {gc} vs {wc}"
    if len(gr) != len(wr):
        return f"rows {len(gr)} vs {len(wr)}"
    if gr == wr:
        return None
    bad = [(g, w) for g, w in zip(gr, wr) if not all(same(x, y, 0) for x, y in zip(g, w))]
    if not bad:
        return None
    near = sum(all(same(x, y, 2e-6) for x, y in zip(g, w)) for g, w in bad)
    return f"{len(bad)} rows differ ({near} only by rounding), first: {bad[0][0]} vs {bad[0][1]} cols {gc}"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--blocks", type=int)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import duckdb

    import __spark_entry__ as entry
    from tapeloom.session import BLOCK_ROWS_CONF, local_session

    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    if args.blocks:
        spark.conf.set(BLOCK_ROWS_CONF, str(args.blocks))
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not args.names or any(a == n or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    failed, total = [], 0.0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, folder)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - t0
            total += took
            if n in sqls:
                cur = con.execute(sqls[n])
                cols = [d[0] for d in cur.description]
                kinds = {r[0]: r[1] for r in con.execute("DESCRIBE " + sqls[n]).fetchall()}
                odd = [f"{c} {t}/{kinds.get(c)}" for c, t in df.dtypes if SAME_TYPE.get(t) != kinds.get(c)]
                cur = con.execute(sqls[n])
                t1 = time.time()
                problem = compare(got, rows_of(cols, cur.fetchall()))
                note = f"oracle {time.time() - t1:.1f}s" + (f" TYPES {odd}" if odd else "")
            else:
                problem, note = None, "rows only"
            if not got[1]:
                note += " EMPTY"
        except Exception as exc:  # report and go on
            problem, took, note = f"{type(exc).__name__}: {str(exc)[:600]}", time.time() - t0, ""
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if problem:
            failed.append(n)
        print(f"{'FAIL' if problem else 'ok  '} {n:34s} {took:6.2f}s rows={len(got[1]) if not problem else '-'} {note} {problem or ''}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} ok, {total:.0f}s; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
