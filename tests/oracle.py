"""Run registered queries next to their SQL in DuckDB and compare the rows.

Usage: python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(t: str) -> str:
    t = str(t).lower()
    if t.startswith(("large_string", "string", "varchar")):
        return "str"
    if t.startswith(("int", "uint", "bigint", "tinyint", "smallint", "hugeint")):
        return t
    return t


def cell(v):
    if v is None:
        return "\\N"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, Decimal):
        return repr(float(v))
    return repr(v)


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(cell(v) for v in r) for r in zip(*cols))


def compare(spark, con, name, sf_dir, queries, oracles):
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    problems = [f"plan has {node}" for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if node in plan]
    got = df.toArrow()
    t1 = time.time()
    if name not in oracles:
        return got.num_rows, None, t1 - t0, 0.0, [*problems, "no SQL"]
    want = con.sql(oracles[name]).to_arrow_table()
    t2 = time.time()
    gs = {f.name: kind(f.type) for f in got.schema}
    ws = {f.name: kind(f.type) for f in want.schema}
    if gs != ws:
        problems.append(f"schema {gs} vs {ws}")
    if got.num_rows != want.num_rows:
        problems.append(f"rows {got.num_rows} vs {want.num_rows}")
    if sorted(gs) == sorted(ws):
        a, b = rows_of(got), rows_of(want)
        if a != b:
            sa, sb = set(a), set(b)
            only_a, only_b = [r for r in a if r not in sb], [r for r in b if r not in sa]
            problems.append(f"values: {len(only_a)} only spark {[str(x)[:300] for x in only_a[:2]]}, "
                            f"{len(only_b)} only sql {[str(x)[:300] for x in only_b[:2]]}")
    return got.num_rows, want.num_rows, t1 - t0, t2 - t1, problems


def main() -> int:
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    from pandekt.session import local_session
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in queries:
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            n, m, ts, td, problems = compare(spark, con, name, sf_dir, queries, oracles)
        except Exception as exc:  # report and go on
            n, m, ts, td, problems = -1, -1, 0, 0, [f"{type(exc).__name__}: {str(exc)[:900]}"]
        real = [p for p in problems if p != "no SQL"]
        bad += bool(real)
        print(f"{'BAD ' if real else 'ok  '} {name} rows={n} spark={ts:.1f}s sql={td:.1f}s {' | '.join(problems)}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
