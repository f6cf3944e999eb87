"""Registered queries and their SQL, one entry per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quilt.plans import analytics, devices, graph, scalars, sparse

_GROUPS = (sparse, graph, scalars, analytics, devices)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for group in _GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
