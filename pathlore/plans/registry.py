"""Catalogue of registered queries: a name, a Spark callable and (where SQL can say it) the DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    import importlib
    import pkgutil

    import pathlore.plans as plans

    for found in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if found.name != "registry":
            importlib.import_module(f"pathlore.plans.{found.name}")
