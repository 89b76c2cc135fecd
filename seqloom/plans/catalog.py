"""Registry of queries: name, callable(spark, sf_dir) and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: Modules that register their queries when they are imported.
MODULES: tuple[str, ...] = ("q_sequence", "q_seeds", "q_align", "q_sv", "q_store", "q_more")


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator that adds a query, and its SQL where there is one."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"seqloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
