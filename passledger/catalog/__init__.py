"""Registry of named queries: a Spark function over the generated tables plus, where SQL can say it, its oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passledger.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}

MODULES = ["observations", "history", "corpus", "scalars", "verdicts", "recall", "ledger", "sets", "gates", "reports", "streams"]


def query(name: str, covers: str = "", sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"passledger.catalog.{module}")
