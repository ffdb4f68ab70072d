"""Compares a registered Spark query with its SQL on the same parquet files.

``python -m tests.oracle [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata")


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([repr([plain(r[i]) for i in order]) for r in rows])


def compare(spark, con, sf_dir: str, fn, sql: str) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    a, x = rows_of(df.columns, got)
    b, y = rows_of(names, want)
    if a != b:
        return False, f"columns {a} != {b}"
    if x != y:
        only_x, only_y = sorted(set(x) - set(y)), sorted(set(y) - set(x))
        return False, (f"{len(x)} vs {len(y)} rows; {len(only_x)} only in Spark, e.g. {only_x[:3]}; "
                       f"{len(only_y)} only in SQL, e.g. {only_y[:3]}")
    return True, f"{len(x)} rows"


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from knownwhen.session import local_session

    sf = argv[0] if argv else "0.001"
    sf_dir = str(DATA / f"sf{sf}")
    spark, con = local_session(8), database(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[1:] or queries:
        t0 = time.time()
        try:
            if name in oracles:
                ok, note = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                ok, note = True, f"{queries[name](spark, sf_dir).count()} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:6.2f}s  {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
