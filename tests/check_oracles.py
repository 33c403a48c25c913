"""Run every query next to its SQL answer: ``python tests/check_oracles.py [sf] [name...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows by value, every cell as text."""
    frame = frame[sorted(frame.columns)]

    def text(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "NULL"
        if isinstance(value, float):
            return repr(value)
        return str(value)

    cells = frame.astype(object).map(text)
    return cells.sort_values(list(cells.columns)).reset_index(drop=True)


def kind(dtype: str) -> str:
    return {"int64": "bigint", "int32": "int"}.get(dtype, dtype)


def compare(spark, con, run, sql: str, sf_dir: str) -> str | None:
    """None when both agree, else what differs."""
    df = run(spark, sf_dir)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = pd.DataFrame(cursor.fetchall(), columns=names, dtype=object)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    types = {d[0]: str(d[1]) for d in cursor.description}
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names_of = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    for column, spark_type in spark_types.items():
        if names_of.get(spark_type) != types[column]:
            return f"{column}: {spark_type} != {types[column]}"
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    if not a.equals(b):
        first = (a != b).any(axis=1).idxmax()
        return f"row {first}: {a.loc[first].to_dict()} != {b.loc[first].to_dict()}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as contract

    from pulsegrid.session import build_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf = f"/root/testdata/sf{scale}"
    session = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(sf)
    oracles = contract.oracle_sql()
    failed = 0
    for name, run in contract.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            if name in oracles:
                problem = compare(session, connection, run, oracles[name], sf)
            else:
                problem = None if run(session, sf).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    session.stop()
