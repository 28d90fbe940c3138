"""Query registry: name -> (spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}

CATALOG_MODULES = ("keelson.plans.catalog", "keelson.plans.catalog_landed", "keelson.plans.catalog_facets", "keelson.plans.catalog_files",
                   "keelson.plans.catalog_models")


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load() -> None:
    import importlib
    for m in CATALOG_MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Builder]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
