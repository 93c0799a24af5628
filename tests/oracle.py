"""Run registered queries and their SQL side by side: python -m tests.oracle [sf dir] [name prefix ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    """Value in a form that is equal across the two engines."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple(sorted((str(k), repr(plain(x))) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return int(v) if isinstance(v, int) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql: str | None, sf_dir: str) -> str | None:
    """None when both results agree, else what differs."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if not a:
        return "no rows"
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}; e.g. {[r for r in a if r not in b][:2]} / {[r for r in b if r not in a][:2]}"
    diff = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(diff)} of {len(a)} rows differ; columns {sorted(names)}; first {diff[0]}" if diff else None


def main() -> None:
    import __spark_entry__ as entry
    from parcelwise.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, q in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, q, sql.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
