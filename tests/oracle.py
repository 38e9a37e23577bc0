"""Run registered queries next to their SQL and compare whole results.

``python tests/oracle.py [--sf 0.01] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return Counter(tuple(_cell(row[n]) for n in order) for row in rows)


def compare(spark, con, folder: str, build, sql: str) -> str | None:
    """None when the results are equal, else what differs."""
    df = build(spark, folder)
    got = _bag(df.columns, (tuple(r) for r in df.collect()))
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = _bag(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"rows {sum(got.values())} against {sum(want.values())}\n  only Spark: {extra}\n  only SQL:   {missing}"
    return None if got else "empty result"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from shelfmark import session
    spark = session.build()
    folder = f"/root/testdata/sf{args.sf}"
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, folder, queries[name], oracles[name])
            else:
                problem = None if queries[name](spark, folder).count() else "empty result"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
