"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "asDict"):
        return norm(value.asDict())
    if isinstance(value, dict):
        return tuple(sorted((k, norm(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return float(value) if type(value).__name__ == "Decimal" else value


def same(spark, sf_dir: str, query, sql: str) -> int:
    rows = query(spark, sf_dir)
    columns = sorted(rows.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in rows.collect()), key=repr)
    duck = duckdb.connect()
    for name in os.listdir(sf_dir):
        duck.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want
    return len(got)
