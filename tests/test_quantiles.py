"""Distributed exact quantiles equal Spark's exact ``percentile``."""

import random

import pytest
from pyspark.sql import functions as F

from souklens.functions.buckets import with_quintiles
from souklens.functions.quantiles import exact_quantiles, running_total

PROBS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 0.5, 0.9, 0.99]


def _spark_percentile(df):
    return df.agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS]))).first()[0]


@pytest.mark.parametrize("rows", [
    [float(random.Random(1).randint(0, 40)) for _ in range(800)],
    [random.Random(2).random() * 1000 for _ in range(3000)],
    [None, None, 1.5, 2.5, 2.5, 10.0],
    [7.0],
    [1.0, 3.0],
    [None],
])
@pytest.mark.parametrize("buckets", [2, 8, 37])
def test_exact_quantiles_equal_percentile(spark, rows, buckets):
    df = spark.createDataFrame([(v,) for v in rows], "v double")
    assert exact_quantiles(df, "v", PROBS, buckets=buckets).first()[0] == _spark_percentile(df)


def test_running_total_is_global(spark):
    df = spark.createDataFrame([(float(i), i % 3 + 1) for i in range(200)], "k double, w int")
    cum, total = running_total(df, "k", "w", buckets=7)
    got = {r.k: r._cum for r in cum.collect()}
    acc = 0
    for i in range(200):
        acc += i % 3 + 1
        assert got[float(i)] == acc
    assert total.first()._n == acc


def test_distributed_quintiles_match_inline(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, float(rnd.randint(1, 500)), float(rnd.choice([1, 1, 1, 2, 5]))) for i in range(400)],
                               "id int, a double, b double")
    specs = [("a", "qa", False), ("b", "qb", True)]
    inline = [tuple(r) for r in with_quintiles(df, specs).orderBy("id").collect()]
    dist = [tuple(r) for r in with_quintiles(df, specs, distributed=("a", "b")).orderBy("id").collect()]
    assert inline == dist


def test_grouped_quantiles_equal_percentile_per_key(spark):
    rnd = random.Random(4)
    # one hot key with most of the rows, a few small keys, a key with only NULLs
    rows = [("hot", rnd.random() * 100) for _ in range(2000)] + [(f"k{i}", float(rnd.randint(0, 9)))
                                                                 for i in range(5) for _ in range(i + 1)]
    rows += [("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("q")).collect()}
    got = {r.g: r._q for r in exact_quantiles(df, "v", PROBS, buckets=6, keys=["g"]).collect()}
    assert {k: v for k, v in want.items() if v is not None} == got


def _brute_gini_lorenz(xs, points):
    xs = sorted(xs)
    n, t = len(xs), sum(xs)
    g = 2.0 * sum((i + 1) * x for i, x in enumerate(xs)) / (n * t) - (n + 1) / n
    ends = {}
    cum = 0.0
    for i, x in enumerate(xs, start=1):
        cum += x
        pt = -(-i * points // n)  # ceil
        ends[pt] = (i, cum)
    return round(g, 4), {pt: (round(r * 100.0 / n, 2), round(c * 100.0 / t, 2)) for pt, (r, c) in ends.items()}


@pytest.mark.parametrize("n_hot, n_rest, points", [(40, 80, 20), (3, 7, 20), (0, 5, 4)])
def test_gini_and_lorenz_with_a_hot_value(spark, n_hot, n_rest, points):
    from souklens.plans.metrics import gini, lorenz

    rnd = random.Random(n_hot + n_rest)
    xs = [12.5] * n_hot + [float(rnd.randint(1, 300)) for _ in range(n_rest)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    want_g, want_l = _brute_gini_lorenz(xs, points)
    assert gini(df).first().gini == pytest.approx(want_g, abs=1e-4)
    got = {r.pt: (r.seller_pct, r.revenue_pct) for r in lorenz(df, points).collect()}
    assert got.keys() == want_l.keys()
    for pt, (sp, rp) in want_l.items():
        assert got[pt][0] == pytest.approx(sp, abs=0.011) and got[pt][1] == pytest.approx(rp, abs=0.011)


def test_filled_quantiles_equal_percentile_of_filled_column(spark):
    from souklens.functions.quantiles import filled_quantiles

    rng = random.Random(9)
    rows = [(rng.choice([None, 0.0, -1.5, 2.0, rng.uniform(-5, 5)]), rng.choice([None, None, 3.0, rng.uniform(0, 1e6)]), None, 7.0)
            for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, n double, one double")
    got = filled_quantiles(df, df.columns, PROBS).first()
    for i, c in enumerate(df.columns):
        m = df.agg(F.median(c)).first()[0]
        want = df.select(F.coalesce(F.col(c), F.lit(m).cast("double")).alias(c)).agg(
            F.percentile(c, F.array(*[F.lit(p) for p in PROBS]))).first()[0]
        assert got[f"_m{i}"] == m
        if want is None:
            assert got[f"_e{i}"] is None
        else:
            assert all(abs(x - y) <= 1e-9 * max(1, abs(y)) for x, y in zip(got[f"_e{i}"], want))
