"""Every query of the library by name, with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules with QUERIES and SQL.
MODULES = ("plans.search", "plans.analysis", "plans.assessment", "plans.candidates", "plans.harness", "plans.sources")


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        part = getattr(import_module(f"sextant.{module}"), name)
        if both := found.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(both)}")
        found |= part
    return found


def queries() -> dict[str, Query]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
