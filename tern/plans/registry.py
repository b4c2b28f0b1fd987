"""Registry of named queries on the driver tables and their DuckDB oracles.

A query is ``fn(spark, sf_dir) -> DataFrame``.  Its oracle, when the
semantics are expressible in plain SQL, is an independent DuckDB statement
over the same Parquet tables (brute force where ours is clever: no grid in
the spatial oracles, a full recompute for incremental tables).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle.strip()
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    # Importing the modules runs their @register decorators.
    from tern.plans import driver_queries  # noqa: F401
