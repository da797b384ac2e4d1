"""Run a query in Spark and its SQL in DuckDB and compare columns, types and rows."""

from __future__ import annotations

import duckdb

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in ("documents", "events"):
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return db


def sortable(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def differences(spark_df, db, sql: str) -> list[str]:
    """What differs, in words; empty when both sides agree."""
    names = sorted(spark_df.columns)
    result = db.execute(sql)
    kinds = {c[0]: str(c[1]) for c in result.description}
    rows = result.fetchall()
    problems = []
    if sorted(kinds) != names:
        return [f"columns {names} against {sorted(kinds)}"]
    for name, kind in spark_df.dtypes:
        if KINDS.get(kind, kind) != kinds[name]:
            problems.append(f"type of {name}: {kind} against {kinds[name]}")
    order = [list(kinds).index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in order) for r in rows), key=sortable)
    ours = sorted((tuple(r) for r in spark_df.select(*names).collect()), key=sortable)
    if ours != theirs:
        left = [r for r in ours if r not in theirs][:3]
        right = [r for r in theirs if r not in ours][:3]
        problems.append(f"{len(ours)} rows against {len(theirs)}; only here {left}; only there {right}")
    return problems
