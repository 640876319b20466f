"""The registered queries bound to a session and a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, catalog_operations, catalog_streams
from ..session import prepared
from .inputs import duckdb_sql, spark_views

Query = Callable[[SparkSession, str], DataFrame]


def _bound(fn: Callable[[catalog.Get], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the driver tables carry times without a zone, which the queries read as UTC
        return fn(spark_views(prepared(spark), sf_dir))

    return run


def all_queries() -> dict[str, Query]:
    return {name: _bound(fn) for name, fn in catalog.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: duckdb_sql(sql) for name, sql in catalog.ORACLE.items()}


def flagship_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_operations.flagship(spark_views(prepared(spark), sf_dir))
