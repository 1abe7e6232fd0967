import random
import zlib
from collections import Counter

import pytest

from souklens.llm import sharding as s


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (3, 3, 6), (0, 4, 2), (4, 0, 3), (30, 10, 25)])
def test_hypergeometric_law(good, bad, draws):
    from math import comb

    rng = random.Random(1)
    seen = Counter(s.hypergeometric(rng, good, bad, draws) for _ in range(20_000))
    for k in range(draws + 1):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) if draws - k <= bad else 0
        assert abs(seen[k] / 20_000 - p) < 0.02 and (p or not seen[k])


def test_large_draws_keep_mean_and_range():
    rng = random.Random(2)
    got = [s.hypergeometric(rng, 10**10, 7 * 10**10, 10**6) for _ in range(30)]
    assert abs(sum(got) / 30 - 125_000) < 400


def test_matrix_has_both_margins():
    rng = random.Random(3)
    rows, sizes = [0, 5, 100, 7, 1], [29, 28, 28, 28]
    m = s.communication_matrix(rows, sizes, rng)
    assert [sum(r) for r in m] == rows and [sum(c) for c in zip(*m)] == sizes


def check(got, n, shards=8):
    per = Counter(r["shard"] for r in got)
    assert len(got) == n and all(per[k] == n // shards + (k < n % shards) for k in range(shards))
    slots = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in per}
    assert all(v == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("n,cell", [(0, 10), (1, 10), (7, 10), (1003, 10_000), (1003, 7)])
def test_sizes_slots_and_columns(docs, n, cell):
    frame = docs([(k % 400 or None, None if k % 9 == 0 else f"t{k % 50}") for k in range(n)]).repartition(5)
    frame = frame.withColumnRenamed("component", "_llm_rank").withColumnRenamed("sig", "cell")
    out = s.shuffle_into_shards(frame, cell_rows=cell)
    assert out.columns == [*frame.columns, "shard", "slot"]
    got = out.collect()
    check(got, n)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in frame.collect())


def test_every_row_goes_everywhere(docs):
    """Over many seeds a row's shard and slot are uniform."""
    frame = docs([(k, "x") for k in range(16)]).coalesce(2)
    seen = Counter()
    for seed in range(30):
        for r in s.shuffle_into_shards(frame, seed=seed).collect():
            seen[r["doc_id"] // 8, r["shard"] // 4, r["slot"]] += 1
    assert len(seen) == 8 and min(seen.values()) > 30


def test_draws_of_rows_and_partitions_are_independent(docs):
    """The joint law: taken in the order of their deal, the rows of one partition tell nothing by their slot keys about the
    deal keys of another partition's rows (or their own), whichever two partitions."""
    import numpy as np

    n, parts = 2_000, 4
    frame = docs([(k, "x") for k in range(n * parts)]).repartition(parts)
    drawn = s.draws(frame, s.SEED, "row", "deal", "key").select("row", "deal", "key").collect()
    deal, key = ([], [])
    for p in sorted({r["row"] >> 33 for r in drawn}):
        rows = sorted((r for r in drawn if r["row"] >> 33 == p), key=lambda r: r["row"])[:1_900]
        deal.append(np.array([r["deal"] for r in rows], float))
        key.append(np.array([r["key"] for r in rows], float))
    for p in range(parts):
        order = np.argsort(deal[p])
        for q in range(parts):
            for x, y in ((key[p][order], deal[q]), (key[p], deal[q]), (key[p][order], key[q])) if p != q else ((key[p], deal[p]),):
                assert abs(np.corrcoef(x, y)[0, 1]) < 0.12, (p, q)


def test_shard_and_slot_are_uniform_together(docs):
    """Pairs of rows of different partitions: every combination of their shards is as frequent as any permutation makes it."""
    frame = docs([(k, "x") for k in range(12)]).coalesce(3)
    seen = Counter()
    for seed in range(60):
        got = {r["doc_id"]: (r["shard"], r["slot"]) for r in s.shuffle_into_shards(frame, shards=2, seed=seed).collect()}
        for a, b in ((0, 4), (4, 8), (1, 9), (3, 7)):
            seen[got[a][0], got[b][0], got[a][1] >= 3] += 1
    assert len(seen) == 8 and min(seen.values()) >= 12


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    frame = s.op3_hypergeometric(spark, sf)
    got = frame.collect()
    check(got, len(texts))
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "rows", None)
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
