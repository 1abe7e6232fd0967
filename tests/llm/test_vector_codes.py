import hashlib

import numpy as np
import pytest

from souklens.llm import vector_codes as vc


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, np.floor(4096 * np.float64(v)).astype(np.int64), y) for i, v, y in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))[:entries]
    x = np.stack([v for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = np.stack([v for _, v, _ in first]).reshape(len(first), parts, -1)
    for step in range(rounds + 1):
        off = ((x[:, None] - books[None]) ** 2).sum(3)
        index = off.argmin(1)
        for p in range(parts if step < rounds else 0):
            for e in range(len(first)):
                if (index[:, p] == e).any():
                    books[e, p] = x[index[:, p] == e, p].sum(0) // (index[:, p] == e).sum()
    digest = hashlib.sha256(",".join(str(n) for p in range(parts) for e in range(len(first)) for n in books[e, p].tolist()).encode()).hexdigest()
    error = off.min(1).sum(1).tolist()
    total = {}
    for (_, _, y), e in zip(kept, error):
        total[y] = total.get(y, 0) + e
    return sorted(((i, "".join(f"{c:02x}" for c in code), e, total[y], digest) for (i, _, y), code, e in zip(kept, index.tolist(), error)), key=str)


def result(spark, rows, **kw):
    f = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "k", 2) for i, v, y in rows],
                              "vec_id long, embedding array<double>, label int, key string, salt int")
    got = vc.encode(f, **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_finds_the_nearest_and_lowest_entry(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-4, 5, size=(40, 3))
    entries[7] = entries[31]
    vectors = np.concatenate([rng.integers(-6, 7, size=(500, 3)), entries])
    index, off = vc.nearest(vectors, entries)
    every = ((vectors[:, None] - entries[None]) ** 2).sum(2)
    assert (index == every.argmin(1)).all() and (off == every.min(1)).all()


def test_search_stops_early():
    looked = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.dtype.kind == "i":
                looked.append(len(key))
            return np.asarray(self)[key]

    entries = np.arange(0, 16_000, 1_000).reshape(-1, 1).repeat(4, 1).view(Watched)
    vectors = np.full((100, 4), 7_010)
    index, _ = vc.nearest(vectors, entries)
    assert (index == 7).all() and sum(n for n in looked if n != 16) <= 100 * 16 / 4  # 16: the sort


@pytest.mark.parametrize("seed,n", [(1, 200), (2, 9)])
def test_against_brute_force(spark, seed, n):
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.normal(size=16) / 4).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(n)]
    assert result(spark, rows) == brute(rows)


def test_defined_cases(spark):
    nan = float("nan")
    rows = [(5, [0.5] * 8, 1), (5, [0.25] * 8, 1), (5, [0.25] * 8, None), (None, [-1.0] * 8, None), (1, None, 1), (2, [nan] * 8, 1),
            (3, [None] * 8, 1), (4, [float("inf")] * 8, 2)]
    assert result(spark, rows, entries=2) == brute(rows, entries=2)
    assert result(spark, []) == []
    # Vectors that can't be cut like the first one are returned without a code.
    got = result(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 9, 1), (3, [], 1)])
    assert [r[:3] for r in got] == [(1, "00" * 8, 0), (2, None, None), (3, None, None)]
    assert [r[1] for r in result(spark, [(1, [1.0] * 9, 1)])] == [None]
    assert [r[1:3] for r in result(spark, [(1, [], 1)])] == [("00" * 8, 0)]


def test_components_beyond_64_bits_fail(spark):
    with pytest.raises(Exception, match="64 bits"):
        result(spark, [(1, [1e30] * 8, 1)])
