import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from souklens.llm import lm


def words(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, order=3):
    each = [Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in (words(t) for _, t in rows)]
    all_, total = Counter(), 0
    for c in each:
        all_.update(c)
        total += sum(v for k, v in c.items() if len(k) == 1)
    out = []
    for (i, t), own in zip(rows, each):
        w, s = words(t), 0.0
        rest = total - len(w)
        for p in range(len(w)):
            for n in range(min(order, p + 1), 0, -1):
                g = tuple(w[p - n + 1:p + 1])
                c = all_[g] - own[g]
                if c:
                    s += math.log(c / (all_[g[:-1]] - own[g[:-1]] if n > 1 else rest))
                    break
                s += math.log(lm.BACKOFF) if n > 1 else -math.log(max(rest, 1))
        out.append((i, len(w), round(s, 6), round(s / len(w), 6) if w else None))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r["doc_id"], r["n_words"], round(r["log_score"], 6),
                    None if r["mean_log_score"] is None else round(r["mean_log_score"], 6)) for r in frame.collect()), key=str)


ROWS = [(k, " ".join(random.Random(k).choices("abcdef", [5, 4, 3, 2, 1, 1], k=random.Random(k).randint(0, 60)))) for k in range(70)]
ROWS += [(70, None), (71, "..."), (None, "a b c"), (3, "a b"), (3, "a b"), (72, "unseen words only here"), (73, "a " * 3000)]


@pytest.mark.parametrize("order,block,part", [(3, 10**6, 10**6), (3, 50, 100), (1, 300, 10**6), (5, 200, 40)])
def test_against_brute_force(docs, order, block, part):
    assert got(lm.stupid_backoff(docs(ROWS).repartition(3), order, block, part)) == brute(ROWS, order)


def test_single_document_and_empty_table(docs):
    assert got(lm.stupid_backoff(docs([(1, "a a")]))) == brute([(1, "a a")])
    assert lm.stupid_backoff(docs([])).collect() == []


def test_differences_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 2**63), (1000, 2**64 - 1), (50, 300)):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (lm.unpack_sorted(lm.pack_sorted(v)) == v).all() and len(lm.unpack_sorted(lm.pack_sorted(v))) == len(v)


def test_byte_planes_round_trip():
    for v in ([], [0], [1, 255, 256, 2**40], list(range(1000))):
        assert lm.unpack_numbers(lm.pack_numbers(np.array(v, np.uint64))).tolist() == v


def test_differences_take_no_more_bytes_than_most_of_them_need():
    v = np.cumsum(np.concatenate([np.full(5000, 200), [2**40], np.full(5000, 200)]).astype(np.uint64), dtype=np.uint64)
    assert (lm.unpack_sorted(lm.pack_sorted(v)) == v).all()
    assert len(lm.pack_sorted(v)) < 2 * len(v)  # one wide gap does not widen all
    assert len(lm.pack_numbers(np.arange(20_000) % 7)) < 5_000


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: (n, m) for i, n, _, m in brute(rows)}
    for r in lm.op8_stupid_backoff(spark, sf).collect():
        n, m = want[r["doc_id"]]
        assert r["n_words"] == n and (m is None and r["mean_log_score"] is None or abs(r["mean_log_score"] - m) < 1e-3)
