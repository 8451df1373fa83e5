"""Compares registered queries with their SQL oracles: ``python tests/check.py sf0.01|folder [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(frame: pd.DataFrame) -> list:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, float):
            return f"{round(x, 9) + 0.0:.9g}"
        return str(x)

    columns = sorted(frame.columns)
    return sorted(tuple(plain(x) for x in row) for row in frame[columns].itertuples(index=False))


def kinds_of(frame: pd.DataFrame) -> dict:
    return {c: str(t) for c, t in frame.dtypes.items()}


def compare(spark, con, folder: str, query, sql: str) -> str:
    ours = query(spark, folder).toPandas()
    theirs = con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    a, b = rows_of(ours), rows_of(theirs)
    if a != b:
        x, y = set(a), set(b)
        return f"rows {len(a)} / {len(b)}; only ours {sorted(x - y)[:2]}; only theirs {sorted(y - x)[:2]}"
    differ = {c for c, t in kinds_of(ours).items() if t != kinds_of(theirs)[c]}
    note = f" (types differ: {sorted((c, kinds_of(ours)[c], kinds_of(theirs)[c]) for c in differ)})" if differ else ""
    return f"ok {len(a)} rows{note}"


def main() -> None:
    import __spark_entry__ as entry
    from pactlens.session import local_session

    folder = sys.argv[1] if "/" in sys.argv[1] else f"/root/testdata/{sys.argv[1]}"
    spark, con = local_session(), connect(folder)
    names = [n for n in entry.queries() if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    failed = 0
    for name in names:
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            if sql is None:
                verdict = f"no oracle, {entry.queries()[name](spark, folder).count()} rows"
            else:
                verdict = compare(spark, con, folder, entry.queries()[name], sql)
        except Exception as e:
            verdict = f"error {type(e).__name__}: {str(e)[:600]}"
        failed += not verdict.startswith(("ok", "no oracle"))
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")


if __name__ == "__main__":
    main()
