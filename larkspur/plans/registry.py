"""Queries by name, each with the SQL that says what it returns, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        key = name or plan.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is taken")
        QUERIES[key] = plan
        if sql:
            ORACLES[key] = sql
        return plan

    return add
