import numpy as np
import pytest

from souklens.llm import topk


def brute(rows, k=5, every=50):
    usable = [(i, np.floor(256 * np.float64(v)).astype(np.int64)) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % every == 0:
            found = sorted((-int(q @ c), j) for j, c in usable if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], "n", 1, 0.5)
                                  for i, v in rows], "vec_id long, embedding array<float>, score string, dim int, norm double")


def result(spark, rows, every=50, **kw):
    f = frame(spark, rows)
    got = topk.search(f, f.filter(f.vec_id % every == 0), **kw)
    return sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("seed,slice_size,block_size,k", [(1, 16_384, 1_024, 5), (2, 40, 3, 5), (3, 7, 2, 1), (4, 64, 8, 90)])
def test_against_brute_force(spark, seed, slice_size, block_size, k):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(size=8) * rng.choice([0.01, 1, 30])).astype(np.float32).tolist()) for i in rng.permutation(400)]
    assert result(spark, rows, k=k, slice_size=slice_size, block_size=block_size) == brute(rows, k)


def test_many_equal_vectors_are_ranked_by_id(spark):
    # A third of the rows score alike for every query: the search goes on over their ids.
    rng = np.random.default_rng(5)
    rows = [(int(i) * 3_000_000_007 - 10 ** 11, [0.5, 0.5, 0.5] if i % 3 else rng.normal(size=3).astype(np.float32).tolist()) for i in rng.permutation(900)]
    rows += [(50, [1.0, 1.0, 1.0]), (-50, [1.0, 0.0, 0.0]), (100, [0.0, 0.0, 0.0])]
    assert result(spark, rows, every=10 ** 6 + 3, slice_size=100) == brute(rows, every=10 ** 6 + 3)
    assert result(spark, rows, slice_size=100) == brute(rows)


def test_rounds_narrow_wide_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 20_000 + (10_000 if i % 2 else 0)).tolist()) for i in range(600)]
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert result(spark, rows, slice_size=150) == brute(exact)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, []), (150, [nan, 1.0]), (200, [None, 1.0]), (250, [inf, 1.0]), (None, [1.0, 1.0]),
            (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [1.0, 2.0, 3.0]), (300, [4.0, 4.0, 4.0]), (350, [9.0])]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    assert result(spark, [(50, [1.0])]) == []
    both = result(spark, [(0, [1.0]), (0, [2.0]), (7, [3.0])])  # a query in two rows is answered for each; neither is its own candidate
    assert both == [(0, 1, 7, 256 * 768), (0, 1, 7, 512 * 768)]


def test_scores_beyond_64_bits_fail(spark):
    with pytest.raises(Exception, match="64 bits"):
        result(spark, [(0, [1e9, 1e9]), (1, [1e9, 1e9])])


@pytest.mark.parametrize("last", [0, 1, 511, 512, 513, 10 ** 6, 2 ** 64 - 1])
def test_bins_cover_the_range(last):
    width = int(topk._width(np.array([last], np.uint64))[0])
    assert (last // width) < topk.BINS and width * topk.BINS > last
