"""Run a registered query in Spark and its SQL in DuckDB and compare all rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

from tarmac.plans.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """A value both engines' results can be reduced to."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return f"dec {value}"
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, int):
        return value
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


SIMPLE = {"tinyint": "int8", "smallint": "int16", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def difference(spark_df, con, sql: str) -> str | None:
    """None if both give the same rows, otherwise what differs first."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    theirs = rows(names, cursor.fetchall())
    ours = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    for name, kind in spark_df.dtypes:
        expected = SIMPLE.get(kind, None)
        if expected and expected != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}"
    for mine, other in zip(ours[1], theirs[1]):
        if mine != other:
            return f"row {dict(zip(ours[0], mine))} != {dict(zip(theirs[0], other))}"
    if not ours[1]:
        return "no rows at all"
    return None
