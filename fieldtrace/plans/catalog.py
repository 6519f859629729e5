"""Registry of the engine's queries and of the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("joins", "relational", "aggregates", "windowed", "scalars", "merges", "composites", "sources", "kernels", "streams", "more", "chains", "further", "roads", "places", "receivers", "rules")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of an equal result if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            # expressions that follow the views of views.sql() begin with a comma
            _SQL[f.__name__] = " ".join(sql.split()).replace(") , ", "), ")
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"fieldtrace.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
