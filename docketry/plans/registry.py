"""Collects the queries of the plan modules and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, control, history, matching, pages, providers, queue, readmodel, receipts, records, replay, review, stamps, structures

_MODULES = [receipts, analytics, queue, control, history, pages, matching, providers, records, readmodel, review, replay, structures, stamps]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
