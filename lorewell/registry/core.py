"""Names, Spark builders and comparison SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lorewell.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(build)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return build(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add
