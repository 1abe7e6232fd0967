import math
import re
from collections import Counter

import numpy as np
import pytest

from souklens.llm import balltree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, words = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (i, bag), size in zip(bags, sizes):
            if size:
                m = 50 + (50 * size * n) // words
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 20 * m))
                        for t in set(terms(text)) if t in bag)
                if s > 0:
                    scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def result(spark, docs, items, k=50, block_words=2_000_000, block_docs=4_096, leaf=32, part_items=2_000):
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, part string, q int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = balltree.search(balltree.build_index(d, block_words, block_docs, leaf), q, k, part_items, leaf)
    return sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n, words=200):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    p = 1 / np.arange(1, words + 1)
    return [(int(i), " ".join(rng.choice(vocabulary, rng.integers(0, 60), p=p / p.sum()))) for i in rng.permutation(n)]


@pytest.mark.parametrize("seed,kw", [(1, {}), (2, dict(block_docs=64, leaf=4, k=7)), (3, dict(block_words=500, leaf=1, k=3, part_items=4))])
def test_against_brute_force(spark, seed, kw):
    docs = corpus(seed, 300)
    items = [(j, t) for j, (_, t) in enumerate(corpus(seed + 50, 12))]
    assert result(spark, docs, items, **kw) == brute(docs, items, kw.get("k", 50))


def test_ties_go_by_doc_id_across_blocks(spark):
    docs = [(int(i), "same old text" if i % 3 else f"other text {i}") for i in np.random.default_rng(4).permutation(600)]
    items = [(1, "old text"), (2, "SAME"), (3, "nothing of this")]
    assert result(spark, docs, items, k=20, block_docs=40, leaf=4) == brute(docs, items, 20)


def test_defined_cases(spark):
    docs = [(1, None), (2, ""), (3, " .,- "), (4, "Ünïcode ÄB äb"), (4, "b2b B2B"), (None, "b2b ab"), (7, "ab"), (8, "ab")]
    items = [(1, "ab äb"), (2, None), (3, "!!"), (None, "b2b"), (1, "b2b b2b"), (5, "Äb"), (6, "äB")]
    assert result(spark, docs, items) == brute(docs, items)
    assert result(spark, [], items) == [] and result(spark, docs, []) == [] and result(spark, [(1, None)], items) == []


def test_long_texts_and_long_items(spark):
    docs = [(1, "a b " * 30_000 + "rare"), (2, "a"), (3, " ".join(f"t{k}" for k in range(20_000)))]
    items = [(1, "rare a"), (2, " ".join(f"t{k}" for k in range(0, 30_000, 2)))]
    assert result(spark, docs, items, leaf=1, block_words=10_000) == brute(docs, items)


def test_bounds_hold_and_prune():
    """No document scores above the bound of any node that holds it, and near copies of a query's text are found without
    opening every leaf."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    topics = [[f"{chr(97 + t)}{k}" for k in range(30)] for t in range(16)]
    texts = [" ".join(rng.choice(topics[i % 16], 30)) for i in range(512)]
    batch = pa.record_batch([pa.array(range(512), pa.int64()), pa.array(texts)], ["id", "text"])
    (row,) = [b.to_pylist()[0] for b in balltree._forward(iter([batch]), 10 ** 9, 10 ** 9)]
    n, words = row["n_docs"], row["n_words"]
    tree = balltree.Block(row, n, words).tree(8)
    table = pa.table({"part": [0] * 16, "item": [str(k) for k in range(16)], "text": [" ".join(t[:10]) for t in topics]})
    part = balltree.Part(balltree._pack_part(table).to_pylist()[0] | {"weights": None})
    part.weights = np.full(len(part.terms), 4_000)
    block = balltree.Block(tree, n, words)
    searcher = balltree.Searcher(block, np.frombuffer(tree["radii"], "<f4"), part, 8)
    assert [len(b) - 1 for b in searcher.levels] == [1, 8, 64]
    opened = 0
    for q in range(16):
        ids, scores, leaves = [], [], []

        def found(places, s):
            leaves.append(1)
            ids.extend(places.tolist())
            scores.extend(s.tolist())
            return sorted(scores)[-5] if len(scores) >= 5 else 1

        searcher.run(q, 1, None, found)
        opened += len(leaves)
        terms_of = part.places[part.starts[q]:part.starts[q + 1]]
        starts, docs, values = searcher.lists[-1]
        exact = np.zeros(512, np.int64)
        for t in terms_of:
            exact[docs[starts[t]:starts[t + 1]]] += 4_000 * values[starts[t]:starts[t + 1]]
        assert sorted(scores)[-5:] == sorted(exact.tolist())[-5:]
        for level, borders in enumerate(searcher.levels):
            bound = searcher.bounds(level, 0, len(borders) - 1, searcher.cells(level, terms_of, part.weights[terms_of]))
            assert (np.maximum.reduceat(exact, borders[:-1]) <= bound).all()
    assert opened < 16 * 64 / 3
