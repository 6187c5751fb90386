"""Query registry: every operator job with its DuckDB oracle.

``register`` records a Spark job ``(spark, sf_dir) -> DataFrame`` under its
SURVEY id together with the oracle SQL (fixture views rendered as ``WITH``).
Jobs without an oracle are checked against brute-force models in tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bindings import sql_with

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def register(name: str, views: tuple[str, ...] = (), oracle: str | None = None):
    def deco(fn: Job) -> Job:
        if name in QUERIES:
            raise ValueError(f"duplicate query id {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = sql_with(views, oracle)
        return fn

    return deco
