"""Registered queries: each runs an operator over the test tables, most with a SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from relearn.catalog.bindings import Tables, for_duckdb

MODULES = ["sources", "library", "practice", "recognition", "sheets", "lifecycle", "identity", "streams"]


@dataclass(frozen=True)
class Case:
    run: Callable[[Tables], DataFrame]
    sql: str | None = None


def cases() -> dict[str, Case]:
    found: dict[str, Case] = {}
    for name in MODULES:
        found.update(import_module(f"relearn.catalog.{name}").CASES)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(case: Case) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: case.run(Tables(spark, folder))

    return {name: bind(case) for name, case in cases().items()}


def oracle_sql() -> dict[str, str]:
    return {name: for_duckdb(case.sql) for name, case in cases().items() if case.sql}
