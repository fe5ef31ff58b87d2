"""Registered queries (Spark side) and their DuckDB oracle texts.

Each entry: ``name -> (fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``.
Column names and types are aligned between both sides; derived doubles are
rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def load_all() -> dict:
    # Importing the modules registers their queries.
    from lapsekit.plans import q_features, q_quality, q_models, q_analytics, q_campaign  # noqa: F401
    return REGISTRY
