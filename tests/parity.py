"""Runs registered queries against their SQL in DuckDB, as the driver does."""

from __future__ import annotations

import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, con, name, query, sql, sf_dir) -> str:
    """Empty if rows and column names agree."""
    got = query(spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(got.columns) != sorted(rel.columns):
        return f"{name}: columns {got.columns} and {rel.columns}"
    a, b = normal(rows, got.columns), normal(want, rel.columns)
    if a != b:
        return f"{name}: {len(a)} and {len(b)} rows; {[x for x in a if x not in set(b)][:3]} and {[x for x in b if x not in set(a)][:3]}"
    return ""


if __name__ == "__main__":
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    import __spark_entry__ as entry
    from orbweave.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark, con = local_session("*", "4g", 8), connection(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in only or [n for n in queries if n in oracle]:
        began = time.time()
        try:
            said = compare(spark, con, name, queries[name], oracle[name], sf_dir)
        except Exception as e:
            said = f"{name}: {type(e).__name__} {str(e)[:300]}"
        bad += bool(said)
        print(said or f"{name} ok", round(time.time() - began, 1), flush=True)
    print("bad", bad)
