"""Queries by name, each with its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from memloom.plans.views import Tables, oracle

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
#: The modules whose plans make up the registry.
MODULES = ("retrieval", "texts", "memories", "graph", "profiles", "commerce", "knowledge", "changes", "indexed", "asked", "files")


def query(sql: str | None, *views: str) -> Callable:
    """Register a function of Tables under its own name; sql is DuckDB's version, views those it uses."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _ORACLES[f.__name__] = oracle(sql, *views)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"memloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
