"""Run a job in Spark and its plain SQL in DuckDB, and compare the rows.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as spark_entry  # noqa: E402
from touchline.session import intermediate_tables, local_session  # noqa: E402


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(root).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in data)


def differences(frame, con, sql: str) -> tuple[int, list[str]]:
    """Row count in Spark and a list of mismatches."""
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    expected = rows(columns, result.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return 0, [f"columns {sorted(set(frame.columns) ^ set(columns))}"]
    found = rows(frame.columns, [tuple(r) for r in frame.collect()])
    problems = [f"only spark {n}x {r}" for r, n in (found - expected).items()]
    problems += [f"only duckdb {n}x {r}" for r, n in (expected - found).items()]
    kinds = {c: t for c, t in frame.dtypes}
    duck_kinds = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    same = {
        "int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE",
        "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
    }
    problems += [f"type {c}: {t} / {duck_kinds[c]}" for c, t in kinds.items() if same.get(t) != duck_kinds[c]]
    return sum(found.values()), problems


def main() -> None:
    args = sys.argv[1:]
    root = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        root, args = args[1], args[2:]
    spark = local_session("8")
    con = duck(root)
    sqls, jobs = spark_entry.oracle_sql(), spark_entry.queries()
    print("without counterpart:", sorted(set(jobs) ^ set(sqls)))
    for name in args or [name for name in jobs if name in sqls]:
        begin = time.time()
        try:
            with intermediate_tables():
                count, problems = differences(jobs[name](spark, root), con, sqls[name])
        except Exception as error:  # noqa: BLE001
            count, problems = -1, [str(error)[:1500]]
        verdict = "ok" if not problems and count else "EMPTY" if not problems else "DIFFERS"
        print(f"{name:36s} {verdict:8s} {count:7d} rows {time.time() - begin:6.1f}s", flush=True)
        for problem in problems[:6]:
            print("    ", problem[:600])


if __name__ == "__main__":
    main()
