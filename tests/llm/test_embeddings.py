import math

import numpy as np
import pytest

from souklens.llm import embeddings as e


def brute(rows):
    def usable(r):
        v = r[1]
        return (r[0] is not None and r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v)
                and any(x != 0 for x in v))

    ids = [r[0] for r in rows]
    root = {i: i for i in ids if i is not None}

    def find(x):
        return x if root[x] == x else find(root[x])

    links = [0] * len(rows)
    good = [k for k, r in enumerate(rows) if usable(r)]
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.float64(rows[k][1]) for k in (a, b))
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(ids[a]), find(ids[b])
                    root[max(p, q)] = min(p, q)
    return sorted(((i, n, None if i is None else find(i)) for i, n in zip(ids, links)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y, "n", 3)
                                  for i, v, y in rows], "vec_id long, embedding array<float>, label int, copies string, dim int")


def result(spark, rows, **kw):
    got = e.linked_vectors(frame(spark, rows), **kw).collect()
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str)


def rows_with_groups(seed, n=220, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    out = []
    for k in range(n):
        c = centres[rng.integers(8)]
        v = c + rng.normal(size=dim) * rng.choice([0, 0.02, 0.12, 0.16, 0.2, 3])
        out.append((k, [float(np.float32(x)) for x in v * rng.choice([1e-3, 1, 50])], int(rng.integers(3))))
    rng.shuffle(order := list(range(n)))
    return [out[k] for k in order]


@pytest.mark.parametrize("seed,tile", [(1, 2048), (2, 9), (3, 40)])
def test_against_brute_force(spark, seed, tile):
    rows = rows_with_groups(seed)
    assert result(spark, rows, tile=tile) == brute(rows)


def test_odd_rows(spark):
    big, tiny = float(np.float32(3e38)), float(np.float32(1e-40))
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.1], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, None, 0),
            (7, [], 0), (8, [0.0, 0.0], 0), (9, [1.0, None], 0), (10, [float("nan"), 1.0], 0), (11, [float("inf"), 1.0], 0),
            (12, [1.0, 0.0, 0.0], 0), (13, [-0.0, 1.0], 0), (14, [0.0, 1.0], 0), (15, [big, big], 2), (16, [big, big * 0.99], 2),
            (17, [tiny, tiny], 2), (None, [1.0, 0.0], 0), (1, [1.0, 0.0], 0)]
    assert result(spark, rows) == brute(rows)
    assert e.linked_vectors(frame(spark, [])).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(300, 24))
    unit /= np.sqrt((unit * unit).sum(1))[:, None]
    codes, scale, error = e.quantise(unit)
    near = (codes.astype(float) @ codes.T.astype(float)) * scale[:, None] * scale[None, :]
    assert (np.abs(near - unit @ unit.T) <= error[:, None] + error[None, :] + error[:, None] * error[None, :] + 1e-12).all()


@pytest.mark.parametrize("dim", [5_000, 10_000])
def test_no_link_is_lost_between_long_vectors(spark, dim):
    """Sums of codes pass 2^24 here; pairs stand just above and just below the threshold."""
    rng = np.random.default_rng(dim)
    rows = []
    for k in range(20):
        v = rng.choice([-1.0, 1.0], dim)
        w = v.copy()
        flipped = rng.choice(dim, int(dim * 0.01) + (k % 2), replace=False)  # cosine 0.98, or a little less
        w[flipped] *= -1
        rows += [(2 * k, v.tolist(), 0), (2 * k + 1, w.tolist(), 0)]
    got = result(spark, rows)
    assert got == brute(rows) and sum(n for _, n, _ in got) == 20


def test_doubles_stay_doubles(spark):
    assert e.single(np.array([[0.5, np.float64(np.float32(0.1))]])) and not e.single(np.array([[0.1]])) and not e.single(np.array([[1e300]]))
    rng = np.random.default_rng(8)
    base = rng.normal(size=6)
    rows = [(k, (base + rng.normal(size=6) * 0.1).tolist(), 0) for k in range(60)] + [(99, (base * 1e300 / 10).tolist(), 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in e.linked_vectors(frame, tile=7).collect()), key=str)
    assert [g for g in got if g[0] != 99] and got == sorted(brute([(i, (np.array(v) / (1e299 if i == 99 else 1)).tolist(), y) for i, v, y in rows]), key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = e.op9_int8_tiles(spark, sf).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute(rows)
