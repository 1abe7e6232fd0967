"""Bucketing.

* B3 ``fixed_bucket``: right-closed bins over fixed edges, lowest edge
  excluded, values outside → NULL (the row then drops out of grouped output).
* B4 ``histogram``: equal-width bins over [min, max] of the data, last bin
  closed; edges come from a one-row aggregate cross-joined back (no collect).
* B1/B2 ``quintile_score``: quantile edges with an equal-width fallback,
  computed in the same plan (see ``quintile_score``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souklens.functions.numeric import col_


def fixed_bucket(c, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (e[i], e[i+1]] holding ``c``; NULL outside."""
    x = col_(c)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def histogram(df: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    """Counts per equal-width bin of ``value`` (NULLs ignored).

    The [min, max] range is a one-row aggregate, cross-joined (a provably
    one-row broadcast); each row then gets its bin by arithmetic, and the
    counts are a grouped aggregate.  Same edge rule as numpy: last bin
    closed; a zero-width range widens to [v - 0.5, v + 0.5].
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    rng = v.agg(F.min("v").alias("lo0"), F.max("v").alias("hi0")).select(
        F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    idx = F.least(F.floor((F.col("v") - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    counts = v.crossJoin(F.broadcast(rng)).groupBy(idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return (counts.crossJoin(F.broadcast(rng)).select(
        F.lit(name).alias("histogram"), "bin",
        F.round((F.col("lo") + F.col("bin") * width).cast("decimal(38,10)"), 4).cast("double").alias("bin_start"),
        F.round((F.col("lo") + (F.col("bin") + 1) * width).cast("decimal(38,10)"), 4).cast("double").alias("bin_end"),
        "count"))


QUINTILE_PROBS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def quintile_of(value: Column, edges: Column, mn: Column, mx: Column) -> Column:
    """1..5 for ``value`` given its quantile edges, minimum and maximum.

    Unique quantile edges → right-closed quantile bins, lowest included.
    Repeated edges → equal-width bins over [min, max] (right-closed, min in
    bin 1); all values equal → bin 3.
    """
    x = value.cast("double")
    q = [edges[i] for i in range(6)]
    unique = (q[0] < q[1]) & (q[1] < q[2]) & (q[2] < q[3]) & (q[3] < q[4]) & (q[4] < q[5])
    by_q = F.when(x <= q[1], 1).when(x <= q[2], 2).when(x <= q[3], 3).when(x <= q[4], 4).otherwise(5)
    step = (mx - mn) / F.lit(5.0)
    by_w = (F.when(mn == mx, 3)
            .when(x <= mn + step * 1, 1).when(x <= mn + step * 2, 2)
            .when(x <= mn + step * 3, 3).when(x <= mn + step * 4, 4).otherwise(5))
    return F.when(x.isNull(), F.lit(None)).when(unique, by_q).otherwise(by_w)


def with_quintile(df: DataFrame, value: str, out: str, reverse: bool = False) -> DataFrame:
    """Add ``out`` = quintile bin of ``value`` (6 - bin when ``reverse``)."""
    return with_quintiles(df, [(value, out, reverse)])


def with_quintiles(df: DataFrame, specs: Sequence[tuple[str, str, bool]], accuracy: int | None = None,
                   distributed: Sequence[str] = ()) -> DataFrame:
    """Add one quintile column per (value, out, reverse) spec.  The edges of
    all specs are one-row aggregates, cross-joined back once.

    Exact edges (default) match the reference's interpolated quantiles.  The
    inline exact aggregate gathers the distinct values of a column in one
    task, so it suits bounded domains (days, counts); value columns listed in
    ``distributed`` (per-entity amounts whose distinct count grows with the
    data) get the same exact edges from ``exact_quantiles`` instead.  For an
    approximate answer with bounded memory pass ``accuracy``
    (``percentile_approx``, rank error about 1/accuracy)."""
    from souklens.functions.quantiles import exact_quantiles

    probs = F.array(*[F.lit(p) for p in QUINTILE_PROBS])
    aggs = []
    edges = []
    for i, (value, _, _) in enumerate(specs):
        v = F.col(value).cast("double")
        if value in distributed and accuracy is None:
            edges.append(exact_quantiles(df, value, QUINTILE_PROBS).select(
                F.col("_q").alias(f"_q{i}"), F.col("_q")[0].alias(f"_mn{i}"), F.col("_q")[5].alias(f"_mx{i}")))
            continue
        q = F.percentile(v, probs) if accuracy is None else F.percentile_approx(v, probs, accuracy)
        aggs += [q.alias(f"_q{i}"), F.min(v).alias(f"_mn{i}"), F.max(v).alias(f"_mx{i}")]
    if aggs:
        edges.append(df.agg(*aggs))
    out = df
    for e in edges:
        out = out.crossJoin(F.broadcast(e))
    for i, (value, name, reverse) in enumerate(specs):
        b = quintile_of(F.col(value), F.col(f"_q{i}"), F.col(f"_mn{i}"), F.col(f"_mx{i}"))
        out = out.withColumn(name, (F.lit(6) - b) if reverse else b)
    return out.drop(*[f"{p}{i}" for i in range(len(specs)) for p in ("_q", "_mn", "_mx")])
