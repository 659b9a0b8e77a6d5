"""Collects the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..bindings import Tables
from ..session import tuned
from . import (
    activity_queries,
    change_queries,
    compare_queries,
    developer_queries,
    file_queries,
    function_queries,
    licence_queries,
    manifest_queries,
    portfolio_queries,
    report_queries,
    rule_queries,
)

MODULES = [
    portfolio_queries, activity_queries, developer_queries, report_queries, compare_queries,
    rule_queries, change_queries, licence_queries, file_queries, function_queries, manifest_queries,
]


def _bound(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(Tables(tuned(spark), folder))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(build) for m in MODULES for name, (build, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
