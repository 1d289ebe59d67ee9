"""All signal queries by name, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sampleloom.jobs import effect_queries, join_queries, store_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (table_queries, effect_queries, join_queries, store_queries):
    for _name, (_query, _sql) in _module.ALL.items():
        QUERIES[_name] = _query
        if _sql is not None:
            ORACLES[_name] = _sql
