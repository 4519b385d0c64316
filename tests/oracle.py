"""Run registered queries and compare them with their SQL twins in DuckDB.

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duckdb_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


# integer, text and other types that both engines must agree on
SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(df, connection, sql: str) -> str | None:
    """Difference of a Spark result and a SQL result as text, None if equal."""
    relation = connection.sql(sql)
    ours = {name: SPARK_TYPES.get(kind, kind) for name, kind in df.dtypes}
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    if ours != theirs:
        return f"schema {ours} != {theirs}"
    left = _rows(df.columns, df.collect())
    right = _rows(relation.columns, relation.fetchall())
    if left == right:
        return None if left else "both sides are empty"
    return (
        f"{sum(left.values())} vs {sum(right.values())} rows; only Spark "
        f"{list((left - right).items())[:2]}; only SQL {list((right - left).items())[:2]}"
    )


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()

    from litscreen.plans.catalog import ORACLES, QUERIES
    from litscreen.session import local_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb_connection(sf_dir)
    bad = []
    for name in args.names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            problem = compare(df, connection, ORACLES[name]) if name in ORACLES else None
            note = "" if name in ORACLES else f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {note} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
