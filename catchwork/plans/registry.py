"""The library's queries and their oracle SQL, by inventory name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catchwork.frames import measured_joins
from catchwork.plans.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SOURCES: dict[str, tuple[str, ...]] = {}
MODULES = ("ingest", "network", "forcing", "loading", "catalogue", "checks", "land", "polygons", "merging", "exports", "evaluate")


def query(name: str, *sources: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of the named views' DataFrames as a query."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SOURCES[name] = sources
        QUERIES[name] = lambda spark, sf_dir: f(*(view(measured_joins(spark), sf_dir, s) for s in sources))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return keep


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"catchwork.plans.{m}")
