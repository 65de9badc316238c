"""Registered queries: each pairs a Spark job over the driver tables with an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from speechtables.session import ship_package

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def job(name: str, sql: str | None = None):
    """Register a job under ``name``; without ``sql`` it is checked in ``tests/`` by brute force."""

    def register(fn: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"{name} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        JOBS[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load() -> None:
    """Import every module that registers jobs."""
    from importlib import import_module

    for module in ("turns", "text", "jobs", "regions", "speakers", "words", "selection", "scoring", "affinity", "io", "streams", "responses"):
        import_module(f"speechtables.catalog.{module}")
