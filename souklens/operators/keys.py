"""Key-presence masks: which tables hold a key, and how often, in one aggregate.

Every table gives a row (domain, key, its bit) for each of its keys; one
``bit_or`` and one count per table and key then answer uniqueness, all orphan
relations on that key, and "orders without children", instead of a distinct
count per table and an anti-join per relation.  Keys are counted map-side
before the exchange, so a key that holds a third of all rows is one row of
each task.  A table is read once however many keys it has.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Source(NamedTuple):
    """A table with its keys by domain, and sums to carry along (NULL is 0)."""

    name: str
    df: DataFrame
    keys: dict[str, str]
    sums: dict[str, Column] = {}


def key_masks(sources: list[Source]) -> DataFrame:
    """(domain, key, mask, n_<source>…, <sum>…): one row per key of a domain.
    The n-th source has bit n of ``mask``; its sums stand on its first key."""
    sums = [(s.name, name) for s in sources for name in s.sums]
    parts = []
    for at, s in enumerate(sources):
        rows = [F.struct(F.lit(domain).alias("domain"), F.col(column).cast("string").alias("key"), F.lit(1 << at).alias("bit"),
                         *[(s.sums[name] if owner == s.name and k == 0 else F.lit(None)).cast("decimal(38,4)").alias(name)
                           for owner, name in sums])
                for k, (domain, column) in enumerate(s.keys.items())]
        one = s.df.select(F.explode(F.array(*rows)).alias("r")) if len(rows) > 1 else s.df.select(rows[0].alias("r"))
        parts.append(one.select("r.*"))
    return (reduce(DataFrame.unionByName, parts).groupBy("domain", "key")
            .agg(F.bit_or("bit").alias("mask"),
                 *[F.count_if(F.col("bit") == 1 << at).alias(f"n_{s.name}") for at, s in enumerate(sources)],
                 *[F.sum(name).alias(name) for _, name in sums]))


def rows_of(name: str, domain: str) -> Column:
    """Aggregate over masks: rows of a source."""
    return F.coalesce(F.sum(F.when(F.col("domain") == domain, F.col(f"n_{name}"))), F.lit(0))


def keys_of(name: str, domain: str) -> Column:
    """Aggregate over masks: distinct keys of a source, NULL not counted."""
    return F.count_if((F.col("domain") == domain) & F.col("key").isNotNull() & (F.col(f"n_{name}") > 0))


def orphans_of(child: str, parent: str, domain: str) -> Column:
    """Aggregate over masks: rows of ``child`` whose key ``parent`` lacks; a NULL key has no parent."""
    alone = (F.col("domain") == domain) & (F.col("key").isNull() | (F.col(f"n_{parent}") == 0))
    return F.coalesce(F.sum(F.when(alone, F.col(f"n_{child}"))), F.lit(0))
