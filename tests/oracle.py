"""Side-by-side comparison of a registered query with its SQL, as the driver does it. Also runnable: python tests/oracle.py SF_DIR NAME..."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from pathlib import Path


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if v.__class__.__name__ == "Decimal":
        return round(float(v), 6)
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def compare(spark, name: str, sf_dir: str) -> tuple[int, str]:
    """Rows of the query, and what differs (empty if nothing does)."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = e.oracle_sql().get(name)
    if sql is None:
        return len(got), ""
    cur = duck(sf_dir).execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return len(got), f"columns {cols} / {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    if got == want:
        return len(got), ""
    a, b = set(map(repr, got)), set(map(repr, want))
    return len(got), f"{len(got)} / {len(want)} rows; only query {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e
    from wherry.session import build_session

    s = build_session(os.environ.get("ORACLE_MASTER", "local[8]"), 8, **{"spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    for n in sys.argv[2:] if len(sys.argv) > 2 else list(e.queries()):
        t = time.time()
        try:
            rows, diff = compare(s, n, sys.argv[1])
        except Exception as x:  # noqa: BLE001
            rows, diff = -1, f"{type(x).__name__}: {str(x)[:1500]}"
        print(f"{n}: {rows} rows, {time.time() - t:.1f} s, {'ok' if not diff else 'DIFF ' + diff}" + ("" if n in e.oracle_sql() else " (no SQL)"), flush=True)
