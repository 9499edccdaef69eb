"""Registered queries and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package that register queries, in reading order.
MODULES: tuple[str, ...] = ("lexical", "dense", "cleaning", "answering", "routing", "home", "composing", "sources")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated (spark, sf_dir) function, with the SQL whose result it must equal."""

    def add(function):
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = function
        if sql:
            _sql[name] = sql
        return function

    return add


def _load() -> None:
    for module in MODULES:
        import_module(f"gleaner.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
