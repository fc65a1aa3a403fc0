"""Registered queries by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codec, events, layout, pool, store, strands

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (layout, strands, codec, pool, events, store):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
