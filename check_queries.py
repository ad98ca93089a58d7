"""Run the registered queries next to their SQL twins and compare the rows.

    python check_queries.py [name prefix ...]

``CHECK_SF_DIR`` names the tables (default sf0.01), ``CHECK_CPUS`` the local threads.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

from clickmill.plans import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """Comparable form of a value; whole floats and ints stay apart, like the column types."""
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    return str(value)


def sorted_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, text: str) -> str | None:
    """None when equal, else the first difference."""
    cursor = con.execute(text)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    mine = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = sorted_rows(names, want)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}" if bad else None


def main(prefixes: list[str]) -> int:
    from tests.conftest import make_session

    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, con = make_session(), open_tables(sf_dir)
    registry.load_all()
    failed = 0
    for name, build in registry.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in registry.ORACLES:
                problem = difference(df, con, registry.ORACLES[name])
                note = problem or "equal"
            else:
                problem, note = None, f"rows only: {df.count()}"
        except Exception as error:  # report and go on with the next query
            problem = note = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:36s} {time.time() - start:6.1f}s  {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
