"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from waymark.plans.views import Views, with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the views under name."""

    def add(make: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if sql:
            ORACLE[name] = with_views(sql)
        return make

    return add
