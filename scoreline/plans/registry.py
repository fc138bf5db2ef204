"""Registry of named queries: a Spark plan builder plus its DuckDB oracle SQL.

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the
driver tables (through the stand-in views of ``sources.fixtures``); building
one starts no job. The oracle SQL states the same rules by another way of
computing, over the very same stand-in view text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import oracle_ctes


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str = ""


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None, operators: str = ""):
    def deco(fn):
        QUERIES[name] = Query(name, fn, sql, operators)
        return fn
    return deco


def osql(fixtures: list[str], ctes: list[tuple[str, str]], select: str) -> str:
    """Oracle SQL: stand-in views + named CTEs + final SELECT."""
    head = oracle_ctes(fixtures).rstrip()
    parts = [head] + [f", {n} AS ({body.strip()})" for n, body in ctes]
    return "\n".join(parts) + "\n" + select.strip()
