"""Run registered queries against their oracle SQL: ``python -m suite.check [sf] [name ...]``."""

from __future__ import annotations

import importlib
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def difference(spark_rows, oracle_rows) -> str | None:
    """None when both hold the same rows, columns sorted by name and order ignored."""
    import pandas as pd
    a, b = spark_rows, oracle_rows
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(set(a.columns) ^ set(b.columns))}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    cols = sorted(a.columns)

    def canon(df):
        df = df[cols].astype(object).where(df[cols].notna(), None)
        number = lambda v: float(v) if hasattr(v, "__float__") and not isinstance(v, str) else v
        return sorted(repr(tuple(map(number, row))) for row in df.itertuples(index=False, name=None))

    x, y = canon(a), canon(b)
    wrong = [(p, r) for p, r in zip(x, y) if p != r]
    return None if not wrong else f"{len(wrong)} of {len(x)} differ, e.g.\n   spark  {wrong[0][0][:400]}\n   oracle {wrong[0][1][:400]}"


def main(argv: list[str]) -> int:
    import duckdb
    sys.path.insert(0, ".")
    entry = importlib.import_module("__spark_entry__")
    from tidewatch.session import local_session
    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = argv[1:] or list(queries)
    wanted = [n for n in queries if any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in wanted)]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            took = time.time() - start
            if name in oracle:
                start = time.time()
                problem = difference(got, db.execute(oracle[name]).df())
                note = f"oracle {time.time() - start:.2f} s"
            else:
                problem, note = None, "no oracle"
        except Exception as exc:  # report and go on to the next query
            problem, took, note = f"{type(exc).__name__}: {str(exc)[:500]}", time.time() - start, ""
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:32s} {len(got) if problem is None else -1:7d} rows {took:6.2f} s  {note}"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
