from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadlake.session import ship_package

from .views import Views
from .views import sql as with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None):
    """Registers ``fn(views) -> DataFrame`` under ``name``, with its check in SQL."""

    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(ship_package(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return add
