"""The registered queries, collected from the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
MODULES = (
    "layout", "cleanup", "verification", "tables", "export", "location", "catalog", "pairing", "ingest", "cascade")


def query(name: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under a name, with the SQL that must give the same rows."""

    def keep(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"folioframe.plans.{module}")
