"""All queries of the core and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ("inventory", "crawl", "graph", "findings", "dedup", "source", "text", "examples", "records", "streams")


def _modules():
    for name in MODULES:
        try:
            yield import_module(f"quern.plans.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"quern.plans.{name}":
                raise


def queries() -> dict[str, Callable]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
