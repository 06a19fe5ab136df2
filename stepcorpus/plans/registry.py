"""Named queries: a Spark builder and, where SQL can say it, a DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def sql_join(left: str, part: str) -> str:
    """SQL form of ``os.path.join(left, part)``."""
    return (f"(case when starts_with({part}, '/') then {part} "
            f"when {left} = '' or ends_with({left}, '/') then {left} || {part} "
            f"else {left} || '/' || {part} end)")


MODULES = ("prompt_queries", "token_queries", "step_queries", "validity_queries", "batch_queries",
           "feature_queries", "scoring_queries", "stage_queries", "source_queries", "image_queries")


def load_all() -> dict[str, Query]:
    """Import every query module so that the registry is complete."""
    import importlib
    for m in MODULES:
        try:
            importlib.import_module(f"stepcorpus.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"stepcorpus.plans.{m}":
                raise
    return REGISTRY
