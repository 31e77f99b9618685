"""Queries by name and the SQL that each is checked against."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "hybrid_full"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, directory) -> DataFrame under its name, with its SQL if there is one."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    """Import the modules that register queries."""
    from lectern import plans

    for m in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"lectern.plans.{m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
