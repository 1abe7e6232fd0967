"""Registered jobs: name → Spark job over ``Layers`` and, where SQL can say
it, the DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from souklens.functions.reuse import releasing
from souklens.oracle.base import compose
from souklens.plans.context import Layers

# name -> (job(layers) -> DataFrame, layer name the job reads or None for Layers itself)
_JOBS: dict[str, tuple[Callable, str | None]] = {}
_SQL: dict[str, str] = {}


def register(name: str, job: Callable, layer: str | None = "star", sql: str | None = None) -> None:
    if name in _JOBS:
        raise ValueError(f"duplicate job {name}")
    _JOBS[name] = (job, layer)
    if sql is not None:
        _SQL[name] = sql


def _load() -> None:
    if _JOBS:
        return
    from souklens.plans import catalog  # noqa: F401  (registers everything)


def run(name: str, layers: Layers) -> DataFrame:
    _load()
    job, layer = _JOBS[name]
    return releasing(lambda: job(getattr(layers, layer) if layer else layers))


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def make(n):
        return lambda spark, sf_dir: run(n, Layers.shared(spark, sf_dir))

    return {n: make(n) for n in _JOBS}


def oracle_queries() -> dict[str, str]:
    _load()
    return {n: compose(q) for n, q in _SQL.items()}


def names() -> list[str]:
    _load()
    return list(_JOBS)
