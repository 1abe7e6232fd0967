"""Aggregate building blocks shared by the jobs.

Everything "per key" here is a grouped aggregate rather than a window:
aggregates combine map-side before the shuffle, so a key that holds a third
of all rows is reduced inside each input task instead of landing whole in
one reducer the way ``row_number().over(partitionBy(key))`` would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souklens.functions.numeric import col_


def asc(c) -> list[Column]:
    """Sort-key parts for ascending order, nulls last."""
    x = col_(c)
    return [x.isNull(), x]


def desc_ts(c) -> list[Column]:
    """Sort-key parts for a timestamp in descending order, nulls last."""
    x = col_(c)
    return [x.isNull(), -F.unix_micros(x.cast("timestamp"))]


def desc_num(c) -> list[Column]:
    """Sort-key parts for a number in descending order, nulls last."""
    x = col_(c)
    return [x.isNull(), -x]


def first_of(order: Sequence[Column], cols: Sequence[str], name: str = "_best") -> Column:
    """Aggregate: a struct holding ``cols`` of the row that sorts first under
    ``order`` (see ``first_by``); combine it with a key's other aggregates so
    one pass gives both.  Read the values back with ``col(f"{name}.{c}")``."""
    parts = [c.alias(f"_k{i}") for i, c in enumerate(order)] + [F.col(c).alias(c) for c in cols]
    return F.min(F.struct(*parts)).alias(name)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the values of ``cols`` from the row that sorts
    first under ``order`` (a list of ascending sort-key parts; include a
    unique column last for a deterministic pick).

    Each column is its own ``min_by`` over the sort key: an ordinary aggregate
    with partial aggregation, so it is skew-safe and needs no window, and a
    consumer that reads only some columns prunes the others down to the scan.
    """
    key = F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(order)])
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), key).alias(c) for c in cols])


def mode_by_count(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent non-null ``value`` per ``keys``; the smallest on ties.

    Two aggregates: counts per (key, value) — combined map-side — then a
    ``min(struct(-count, value))`` per key.
    """
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    return (counts.groupBy(*keys)
            .agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_m"))
            .select(*keys, F.col("_m.v").alias(out)))


def sorted_set_join(c, sep: str) -> Column:
    """Aggregate: distinct non-null values, sorted, joined by ``sep``."""
    return F.array_join(F.array_sort(F.collect_set(col_(c))), sep)
