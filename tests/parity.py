"""Runs queries beside their DuckDB SQL: python -m tests.parity SF [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat().replace("+00:00", "")
    if value is None or value != value:
        return None
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name: str, query, sql: str | None, sf_dir: str) -> str:
    began = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - began
    if sql is None:
        return f"rows {len(got)} ({took:.1f} s)"
    result = connect(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} {sorted(names)}"
    if got != want:
        a, b = set(got), set(want)
        return f"DIFFER {len(got)} {len(want)} only spark {list(a - b)[:3]} only sql {list(b - a)[:3]}"
    return f"ok {len(got)} ({took:.1f} s)"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lorefold.session import build_session

    session = build_session(f"local[{__import__("os").environ.get("PARITY_CPUS", "8")}]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for wanted in sys.argv[2:] or queries:
        try:
            print(wanted, compare(session, wanted, queries[wanted], oracle.get(wanted), f"{DATA}/{sys.argv[1]}"), flush=True)
        except Exception as error:
            print(wanted, "ERROR", str(error)[:700], flush=True)
