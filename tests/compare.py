"""Runs queries beside their oracle SQL on one folder: python tests/compare.py FOLDER [NAME...]."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if hasattr(x, "as_integer_ratio") and not isinstance(x, int):
        return float(x)
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, folder: str, f, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty if query and oracle agree in columns and rows."""
    df = f(spark, folder)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    b = rows(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; {[x for x in a if x not in set(b)][:2]} {[x for x in b if x not in set(a)][:2]}" if len(a) < 50_000 else f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ: {bad[0]}" if bad else ""


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    from factloom.session import local_session

    spark, con = local_session(8), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, failed = entry.queries(), entry.oracle_sql(), 0
    for n in names or sorted(oracles):
        try:
            why = difference(spark, folder, queries[n], oracles[n], con)
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:400]}"
        failed += bool(why)
        print("ok " if not why else "BAD", n, why[:600], flush=True)
    return failed


if __name__ == "__main__":
    os._exit(min(1, main(sys.argv[1], sys.argv[2:])))
