"""Name -> query registry.  A query is ``fn(catalog) -> DataFrame``; the
registered callable takes ``(spark, sf_dir)`` as the driver expects."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattline.sources.tables import Catalog

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

_MODULES = (
    "wattline.plans.rowwise",
    "wattline.plans.traces",
    "wattline.plans.metrics",
    "wattline.plans.profiles",
    "wattline.plans.analytics",
    "wattline.plans.workloads",
    "wattline.plans.monitoring",
    "wattline.plans.modelling",
)


def register(name: str):
    def deco(fn: Callable[[Catalog], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Catalog(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        run.__module__ = fn.__module__
        _REGISTRY[name] = run
        return fn
    return deco


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for m in _MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:
            if e.name != m:
                raise
    return dict(_REGISTRY)
