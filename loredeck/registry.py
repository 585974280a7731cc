"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("lookups", "search", "textops", "metrics", "evaluation", "calendar", "maintenance", "streams", "folders", "issues", "audits", "stores", "rules", "answers", "golden", "reports", "parses")


def operator(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a unique name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered already")
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        if importlib.util.find_spec(f"loredeck.plans.{m}"):
            importlib.import_module(f"loredeck.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
