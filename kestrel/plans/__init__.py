"""Registered queries: one Spark plan per operator, each with its DuckDB oracle SQL.

``register`` records a builder ``(spark, sf_dir) -> DataFrame`` under a name together with
the equivalent SQL over the driver's tables (or ``None`` when the operator is not
SQL-expressible).  ``load_all`` imports every family module so the registry is complete.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Builder
    oracle: str | None
    family: str


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, oracle, fn.__module__.rsplit(".", 1)[-1])
        return fn
    return deco


FAMILIES = ("history", "text", "ingest", "moderation", "feedback", "serving", "drift", "ml", "ops")


def load_all() -> dict[str, QuerySpec]:
    import importlib
    for fam in FAMILIES:
        importlib.import_module(f"{__name__}.{fam}")
    return REGISTRY
