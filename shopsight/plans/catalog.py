"""Registry of named queries: a Spark builder plus, where SQL can express it,
an equivalent DuckDB statement over the same parquet tables (the oracle)."""

from __future__ import annotations

import importlib
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}

_MODULES = ("q_kpi", "q_ingest", "q_star", "q_shapes", "q_basket", "q_segments",
            "q_reports", "q_advice", "q_jobs")


def query(name: str, sql: str | None = None, covers: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, covers)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    for m in _MODULES:
        importlib.import_module(f"shopsight.plans.{m}")
    return REGISTRY
