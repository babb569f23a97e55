"""Run registered queries beside their SQL on the same tables and compare.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, int) and not isinstance(value, bool):
        return round(float(value), 5)
    if hasattr(value, "as_tuple"):
        return round(float(value), 5)
    return value


def differences(names: list[str], rows, oracle_names: list[str], oracle_rows) -> str | None:
    if sorted(names) != sorted(oracle_names):
        return f"columns {sorted(names)} != {sorted(oracle_names)}"
    order, oracle_order = ([n.index(c) for c in sorted(n)] for n in (names, oracle_names))

    def normal(rs, idx):
        return sorted((tuple(_plain(r[i]) for i in idx) for r in rs), key=repr)

    a, b = normal(rows, order), normal(oracle_rows, oracle_order)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else None


def compare(spark, db, sf_dir: str, name: str) -> tuple[str | None, int, list, list]:
    import __spark_entry__ as entry
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return (None if rows else "no rows"), len(rows), df.dtypes, []
    found = db.execute(sql)
    described = [(d[0], str(d[1])) for d in found.description]
    problem = differences(df.columns, rows, [d[0] for d in described], found.fetchall())
    return problem, len(rows), df.dtypes, described


def main() -> None:
    from foldwise.session import local_session
    import __spark_entry__ as entry
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db = database(sf_dir)
    failed = 0
    for name in sys.argv[2:] or list(entry.queries()):
        began = time.time()
        try:
            problem, n, types, described = compare(spark, db, sf_dir, name)
        except Exception as error:  # report and go on
            problem, n, types, described = f"{type(error).__name__}: {str(error)[:600]}", 0, [], []
        failed += problem is not None
        kind = "sql " if name in entry.oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - began:6.1f}s "
              f"{n:8d} {name} {problem or ''}", flush=True)
        if described and "-t" in sys.argv:
            print("    ", types, described)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
