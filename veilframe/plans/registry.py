"""Named query catalogue: each entry is a Spark builder ``(spark, sf_dir) ->
DataFrame`` plus, where the semantics are SQL-expressible, an independent
DuckDB formulation used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    build: Builder
    oracle: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None = None, operators: tuple[str, ...] = ()):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, oracle, operators)
        return fn
    return deco


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL literal (DuckDB standard strings)."""
    return "'" + s.replace("'", "''") + "'"
