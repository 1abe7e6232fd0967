"""Tables that one job reads several times.

A per-entity table (persons, sellers) that is scored against its own medians
and quantile edges appears in its plan once for every aggregate.  ``reused``
marks it for lazy caching on the executors, with disk as the overflow: it is
computed once, when the job first runs, its plan stays small, and blocks lost
with an executor are computed again.  Nothing runs or is written while the
plan is built.

``releasing`` ties the cached tables to the job's result: they leave the
executors' storage when the result DataFrame is no longer held.  Jobs that mark
the same table share it; it leaves with the last of them.  A plan that outlives
them stays right and computes it again.  ``reusing`` is for a job that runs its
queries while it is built: what they marked leaves at the end of the block.
"""

from __future__ import annotations

import weakref
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_SCOPE: ContextVar[list[DataFrame] | None] = ContextVar("cached tables of the job being built", default=None)
# How many results hold a cached table, by session and meaning of its plan.
_HOLDERS: Counter = Counter()


def _meaning(df: DataFrame) -> tuple:
    return df.sparkSession.sparkContext.applicationId, df.semanticHash()


def reused(df: DataFrame) -> DataFrame:
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    if (scope := _SCOPE.get()) is not None:
        scope.append(cached)
    return cached


def releasing(build: Callable[[], DataFrame]) -> DataFrame:
    """Build a job; what it marked with ``reused`` is released with its result."""
    cached: list[DataFrame] = []
    token = _SCOPE.set(cached)
    try:
        result = build()
    finally:
        _SCOPE.reset(token)
    if cached:
        weakref.finalize(result, _release, _hold(cached), result.sparkSession).atexit = False
    return result


@contextmanager
def reusing() -> Iterator[None]:
    """What is marked with ``reused`` inside the block is released at its end."""
    cached: list[DataFrame] = []
    token = _SCOPE.set(cached)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        if cached:
            _release(_hold(cached), cached[0].sparkSession)


def _hold(cached: list[DataFrame]) -> list[tuple[DataFrame, tuple]]:
    held = [(df, _meaning(df)) for df in cached]
    _HOLDERS.update(key for _, key in held)
    return held


def _release(held: list[tuple[DataFrame, tuple]], spark) -> None:
    for df, key in held:
        _HOLDERS[key] -= 1
        if not _HOLDERS[key]:
            del _HOLDERS[key]
            if spark.sparkContext._jsc is not None:  # the session may have ended meanwhile
                df.unpersist()
