"""Comparing Spark results with DuckDB results."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def open_tables(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


# The type names that mean the same in Spark and DuckDB.
SAME_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def differences(df, connection, sql):
    """Reasons why `df` and the SQL result differ; empty if they agree."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    types = {row[0]: row[1] for row in described}
    problems = []
    for name, kind in df.dtypes:
        if name not in types:
            problems.append(f"column {name} is not in the SQL result")
        elif SAME_TYPES.get(kind) != types[name]:
            problems.append(f"{name}: {kind} against {types[name]}")
    problems += [f"column {n} is missing" for n in names if n not in df.columns]
    if problems:
        return problems
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if found != expected:
        extra, missing = found - expected, expected - found
        problems.append(
            f"{sum(found.values())} rows against {sum(expected.values())}; "
            f"extra {list(extra)[:3]}; missing {list(missing)[:3]}"
        )
    return problems


def rows(df, *columns):
    """Sorted row tuples, nulls first."""
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
