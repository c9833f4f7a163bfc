"""Run a registered plan and its SQL twin and compare rows, column names and column types."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()  # fmt: skip


def connect(sf: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return db


def _key(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}" if value else "0"
    if isinstance(value, (list, tuple)):
        return tuple(_key(v) for v in value)
    return str(value)


def _kind(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def compare(spark_rows, columns, oracle_rows, oracle_columns) -> str | None:
    """None when equal, else what differs."""
    if sorted(columns) != sorted(oracle_columns):
        return f"columns {sorted(columns)} != {sorted(oracle_columns)}"
    if len(spark_rows) != len(oracle_rows):
        return f"rows {len(spark_rows)} != {len(oracle_rows)}"
    order, other = sorted(columns), {c: i for i, c in enumerate(oracle_columns)}
    mine = {c: i for i, c in enumerate(columns)}
    left = sorted(tuple(_key(r[mine[c]]) for c in order) for r in spark_rows)
    right = sorted(tuple(_key(r[other[c]]) for c in order) for r in oracle_rows)
    for a, b in zip(left, right, strict=True):
        if a != b:
            return f"{order}: {a} != {b}"
    for c in order:
        kinds = {_kind(r[mine[c]]) for r in spark_rows[:200]} - {None}
        others = {_kind(r[other[c]]) for r in oracle_rows[:200]} - {None}
        if kinds and others and kinds != others:
            return f"type of {c}: {kinds} != {others}"
    return None


def run(spark, sf: str, names=None) -> dict[str, str]:
    from __spark_entry__ import oracle_sql, queries

    db, plans, oracles, failed = connect(sf), queries(), oracle_sql(), {}
    for name in names or plans:
        began = time.time()
        try:
            df = plans[name](spark, sf)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - began
            problem = None
            sql_took = 0.0
            if name in oracles:
                began = time.time()
                cur = db.execute(oracles[name])
                cols = [d[0] for d in cur.description]
                problem = compare(rows, df.columns, cur.fetchall(), cols)
                sql_took = time.time() - began
            elif not rows:
                problem = "no rows"
        except Exception as exc:  # noqa: BLE001 - reported per query
            problem, took, sql_took, rows = f"{type(exc).__name__}: {str(exc)[:600]}", time.time() - began, 0.0, []
        if problem:
            failed[name] = problem
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {len(rows):7d} rows {took:6.2f}s sql {sql_took:5.2f}s"
              f"{'' if name in oracles else ' (rows only)'} {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    from corvane.session import local_session

    bad = run(local_session(), sys.argv[1], sys.argv[2:] or None)
    print(f"{len(bad)} failed: {sorted(bad)}")
