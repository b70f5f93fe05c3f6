"""Compare registered queries with their SQL in DuckDB: rows, column names and values."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from glob import glob

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (bytearray, bytes)):
        return bytes(value).hex()
    return value


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def compare(spark, db, name: str, sf_dir: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = contract.queries()[name](spark, sf_dir)
    got = df.collect()
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    wanted = db.execute(sql)
    columns = [d[0] for d in wanted.description]
    rows = wanted.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    left, right = _rows(df.columns, got), _rows(columns, rows)
    if left != right:
        return f"{len(got)} rows against {len(rows)}; only here {list((left - right).items())[:2]}, only SQL {list((right - left).items())[:2]}"
    return None


if __name__ == "__main__":
    from sparklog.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    session = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    database = connect(folder)
    chosen = sys.argv[1:] or sorted(contract.queries())
    failed = 0
    for query in chosen:
        begun = time.time()
        try:
            problem = compare(session, database, query, folder)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - begun:6.1f}s {query} {problem or ''}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree")
