"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Every registered builder takes (spark, sf_dir) and returns a DataFrame over
the driver tables; the oracle is the same query as DuckDB SQL over the same
tables (pre-registered as views by the checker).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    build: Builder
    sql: str | None
    ids: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``ids`` are the survey rows it covers."""

    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, tuple(ids.split()))
        return fn

    return deco
