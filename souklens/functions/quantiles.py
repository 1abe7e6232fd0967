"""Exact quantiles whose work stays distributed.

Spark's exact ``percentile`` merges one value→count map per group, so a
global percentile gathers every distinct value into one final task.  That is
fine for bounded domains (whole days, scores, cents of a price list) but not
for per-entity values whose distinct count grows with the data (a person's
spend or lifetime value).  ``exact_quantiles`` gives the same numbers
(linear interpolation between the two closest ranks, Spark's formula) from:

1. counts per distinct value — a grouped aggregate, combined map-side;
2. a global running total of those counts: values are cut into ranges by
   their exponent and leading bits (``buckets`` ranges between two powers of
   two; a function of the value alone, so every consumer agrees and no pass
   over the data places the edges), a running sum inside each range (a window
   partitioned by range), plus the total of all lower ranges (a table with
   one row per range);
3. for every wanted rank, the value whose cumulative range covers it — a
   global aggregate of conditional maxima, whose buffer has a constant size.

No step holds more than one range of distinct values in a task, and there
are at most ``buckets`` ranges per octave that occurs, whatever the data size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Ranges between two powers of two.
RANGES_PER_OCTAVE = 512


def value_range(c, per_octave: int = RANGES_PER_OCTAVE) -> Column:
    """An order-preserving range number of a double: sign, exponent and the
    leading part of the mantissa.  0 stands for itself; infinities lie beyond
    every finite range."""
    x = F.abs(c)
    e = F.floor(F.log2(x))
    at = (e + 1100) * per_octave + F.floor((x / F.pow(F.lit(2.0), e.cast("double")) - 1) * per_octave) + 1
    n = F.when(x == 0, F.lit(0)).when(x == F.lit(float("inf")), F.lit(1 << 40)).otherwise(at).cast("long")
    return F.when(c < 0, -n).otherwise(n)


def running_total(df: DataFrame, order: str, weight: str | Sequence[str], buckets: int | None = None,
                  keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``df`` (``order`` unique per row within ``keys``) with ``_cum`` = sum of
    ``weight`` over the rows of the same ``keys`` with ``order`` ≤ this row's,
    and the totals ``_n`` (one row per key; one row overall without keys).
    For a list of weights the columns are ``_cum_<w>`` and ``_n_<w>``.

    Ranges cut every key's values alike, so a key holding a third of all
    values is still spread over its ranges."""
    keys = list(keys)
    single = isinstance(weight, str)
    weights = [weight] if single else list(weight)
    cum_name = (lambda w: "_cum") if single else (lambda w: f"_cum_{w}")
    tot_name = (lambda w: "_n") if single else (lambda w: f"_n_{w}")
    b = df.withColumn("_p", value_range(F.col(order).cast("double"), buckets or RANGES_PER_OCTAVE))
    w_local = Window.partitionBy(*keys, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    w_off = Window.partitionBy(*keys).orderBy("_p")
    # range sizes: one row per occurring range and key
    sizes = b.groupBy(*keys, "_p").agg(*[F.sum(w).alias(f"_ps{i}") for i, w in enumerate(weights)])
    off = sizes.select(*keys, "_p", *[(F.sum(f"_ps{i}").over(w_off) - F.col(f"_ps{i}")).alias(f"_off{i}")
                                      for i in range(len(weights))])
    cum = (b.withColumns({f"_lc{i}": F.sum(w).over(w_local) for i, w in enumerate(weights)})
           .join(off, [*keys, "_p"])
           .withColumns({cum_name(w): F.col(f"_off{i}") + F.col(f"_lc{i}") for i, w in enumerate(weights)})
           .drop("_p", *[f"{p}{i}" for i in range(len(weights)) for p in ("_lc", "_off")]))
    # one row per key, from the range sizes
    return cum, sizes.groupBy(*keys).agg(*[F.sum(f"_ps{i}").alias(tot_name(w)) for i, w in enumerate(weights)])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], buckets: int | None = None,
                    keys: Sequence[str] = ()) -> DataFrame:
    """``_q`` = array of the exact ``probs`` quantiles of ``value`` (NULLs
    ignored; NULL when there is no value), equal to ``percentile(value,
    array(probs))``: one row, or one row per ``keys`` with a value."""
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
              .agg(F.count(F.lit(1)).alias("_c")))
    cum, total = running_total(counts, "_v", "_c", buckets, keys)
    x = cum.join(total, keys) if keys else cum.crossJoin(F.broadcast(total))
    first = F.col("_cum") - F.col("_c")  # 0-based rank of the value's first copy

    def at(rank):
        return F.max(F.when((first <= rank) & (rank < F.col("_cum")), F.col("_v")))

    aggs = [F.max("_n").alias("_n")]
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        aggs += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}")]
    one = x.groupBy(*keys).agg(*aggs)
    qs = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        vlo, vhi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        qs.append(F.when((hi == lo) | (vhi == vlo), vlo)
                  .otherwise((hi.cast("double") - pos) * vlo + (pos - lo.cast("double")) * vhi))
    return one.select(*keys, F.when(F.col("_n") > 0, F.array(*qs)).alias("_q"))


def _interpolate(pos: Column, lo: Column, hi: Column) -> Column:
    low, high = F.floor(pos), F.ceil(pos)
    return F.when((high == low) | (hi == lo), lo).otherwise((high.cast("double") - pos) * lo + (pos - low.cast("double")) * hi)


def filled_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row: for each column its median ``_m0``, ``_m1``, … and the exact
    ``probs`` quantiles ``_e0``, ``_e1``, … of the column with its NULLs
    replaced by that median.  One distributed pass for all columns.

    With n values, z NULLs and median m, the filled column in order is the
    values below m, the values equal to m and z copies of m, and the values
    above m.  Rank r is therefore the r-th value where that lies below m, the
    (r - z)-th value where that lies above m, and m in between."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("v"))
                                         for i, c in enumerate(cols)])).alias("x")).select("x.k", "x.v")
    counts = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("p", value_range(F.col("v")))
    sizes = counts.groupBy("k", "p").agg(F.sum("c").alias("s"))
    whole = Window.partitionBy("k")
    offsets = sizes.select(
        "k", "p", (F.sum("s").over(whole.orderBy(F.col("p").asc_nulls_last())) - F.col("s")).alias("before"),
        F.coalesce(F.sum(F.when(F.col("p").isNotNull(), F.col("s"))).over(whole), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("p").isNull(), F.col("s"))).over(whole), F.lit(0)).alias("z"))
    inside = Window.partitionBy("k", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counts.where(F.col("p").isNotNull()).withColumn("upto", F.sum("c").over(inside)).join(offsets, ["k", "p"])
              .withColumn("last", F.col("before") + F.col("upto")))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("last") - F.col("c") <= rank) & (rank < F.col("last")), F.col("v")))

    half = (F.col("n") - 1).cast("double") * F.lit(0.5)
    spots = {f"r{i}": (F.col("n") + F.col("z") - 1).cast("double") * F.lit(float(p)) for i, p in enumerate(probs)}
    aggs = [F.max("n").alias("n"), F.max("z").alias("z"), at(F.floor(half)).alias("mlo"), at(F.ceil(half)).alias("mhi")]
    for name, pos in spots.items():
        for end, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs += [at(rank).alias(f"{name}_{end}"), at(rank - F.col("z")).alias(f"{name}_{end}z")]
    one = ranked.groupBy("k").agg(*aggs).withColumn("m", _interpolate(half, F.col("mlo"), F.col("mhi")))

    def filled(name: str) -> Column:
        low, high, m = F.col(name), F.col(f"{name}z"), F.col("m")
        return F.when(low < m, low).when(high > m, high).otherwise(m)

    edges = F.array(*[_interpolate(pos, filled(f"{name}_lo"), filled(f"{name}_hi")) for name, pos in spots.items()])
    one = one.select("k", "m", edges.alias("e"))
    return one.agg(*[F.max(F.when(F.col("k") == i, F.col(x))).alias(f"_{x}{i}") for i in range(len(cols)) for x in "me"])
