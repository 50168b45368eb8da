"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math

import duckdb

from findling import schemas

KINDS = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in schemas.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(names, data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, folder: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        if node in plan:
            return f"the plan holds a {node}"
    result = con.execute(sql)
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    theirs = result.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(kinds):
        return f"columns {sorted(df.columns)} against {sorted(kinds)}"
    if dict(df.dtypes) != kinds:
        mine = dict(df.dtypes)
        return "types " + str({c: (mine[c], kinds[c]) for c in kinds if mine[c] != kinds[c]})
    a, b = rows(df.columns, ours), rows(list(kinds), theirs)
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        return f"{len(a)} against {len(b)} rows; only ours {list(left)[:3]}; only SQL {list(right)[:3]}"
    return None if a else "no rows"
