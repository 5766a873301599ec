"""Registry of named queries: a Spark builder plus (optionally) its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLE[name] = oracle
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    from . import catalog, hardened, intake  # noqa: F401  (register on import)
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalog, hardened, intake  # noqa: F401
    return dict(_ORACLE)
