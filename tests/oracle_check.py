"""Run registered queries beside their SQL in DuckDB and compare whole results.

usage: python tests/oracle_check.py [--sf 0.01] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import numpy as np

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, sf_dir):
    """None when equal, else a short text on the difference."""
    df = entry.queries()[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got_cols else "no columns"
    res = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first spark {got[:2]} sql {want[:2]}"
    if not got:
        return "both empty"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ in {got_cols}: {bad[:2]}" if bad else None


def main() -> int:
    from tabulith.session import local_session
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        args = args[:i] + args[i + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), duck(sf_dir)
    failed = []
    names = [n for n in entry.queries() if not args or any(n.startswith(a) for a in args)]
    for n in names:
        t = time.time()
        try:
            err = compare(spark, con, n, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            err = "".join(traceback.format_exception_only(e))[:1500]
        if err:
            failed.append(n)
        kind = "sql " if n in entry.oracle_sql() else "rows"
        print(f"{'FAIL' if err else 'ok  '} {kind} {time.time() - t:6.2f}s {n} {err or ''}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} match; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
