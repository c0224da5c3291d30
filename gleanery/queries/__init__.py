"""Registered queries: each operator run over the given tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("cleaning", "rules", "catalog", "metrics", "alerting", "sequences", "extraction", "streams", "storage")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, the equivalent SQL."""

    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query already registered: {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"gleanery.queries.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(sorted(_QUERIES.items()))


def all_oracles() -> dict[str, str]:
    _load()
    return dict(sorted(_ORACLES.items()))
