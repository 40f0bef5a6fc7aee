"""Registry of catalog queries: name -> Spark plan builder (+ DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.oracle_views import with_views


@dataclass(frozen=True)
class Entry:
    name: str
    ids: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def register(name: str, ids: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, ids, fn, with_views(sql) if sql else None)
        return fn

    return deco
