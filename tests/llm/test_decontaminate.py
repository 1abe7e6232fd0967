import hashlib
import random
import re

import numpy as np
import pytest

from souklens.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k:k + 13]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, tmp_path, docs, rows, items, part_words=d.PART_WORDS, block_words=d.BLOCK_WORDS, monkeypatch=None):
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    index = d.build_index(docs(rows), block_words=block_words)
    found = d.search(index, spark.createDataFrame(items, "item_id long, text string"), part_words=part_words)
    return sorted(((r["id"], r["n_words"], r["n_hit"], len(r["items"]),
                    hashlib.sha256(",".join(r["items"]).encode()).hexdigest(),
                    r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in found.collect()), key=str)


def case(seed, vocabulary):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(vocabulary)] + ["é", "Naïve", "x1"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 12, 13, 14, 30])))) for k in range(25)]
    items += [(3, "w1 w2"), (100, None), (101, "..."), (None, "only here")]
    rows = []
    for n in range(80):
        t = rng.choices(vocab, k=rng.choice([0, 1, 5, 40, 300]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            piece = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(piece) - 13))
            at = rng.randint(0, len(t))
            t[at:at] = [p.upper() for p in piece[a:a + rng.choice([12, 13, 20, 40])]]
        rows.append((n, rng.choice([" ", ", ", "\n", "_"]).join(t)))
    return rows + [(500, None), (501, ""), (502, "!!"), (7, "w1 w2 w3"), (503, "only Here")], items


@pytest.mark.parametrize("seed,vocabulary,part_words,block_words", [(1, 40, 10**6, 200_000), (2, 4000, 60, 300), (3, 6, 10**6, 900)])
def test_against_brute_force(spark, tmp_path, docs, seed, vocabulary, part_words, block_words):
    rows, items = case(seed, vocabulary)
    assert run(spark, tmp_path, docs, rows, items, part_words, block_words) == brute(rows, items)


def test_query_on_the_test_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = d.op6_positional_index(spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)


def test_empty_tables(spark, tmp_path, docs):
    rows, items = case(4, 30)
    assert run(spark, tmp_path / "a", docs, rows, []) == brute(rows, [])
    assert run(spark, tmp_path / "b", docs, [], items) == []


def test_places_beyond_16_bits():
    text = [b"a"] * 70_000 + [b"b", b"c"]
    table = d.Interner()
    numbers = table.numbers(text)
    places = np.argsort(numbers, kind="stable").astype(np.uint32)
    block = d.Block([len(text)], b" ".join(table), np.bincount(numbers).astype("<u4").tobytes(),
                    (places & 0xFFFF).astype("<u2").tobytes(), (places >> 16).astype("<u2").tobytes())
    assert [(w, p.tolist()) for w, p, _ in block.search(d.Windows([("1", b"a b c")]))] == [(0, [69_999])]


def test_proximity_matches(docs, spark):
    rows = [(1, "alpha x beta gamma"), (2, "beta alpha gamma"), (3, "alpha far far far far far beta gamma"), (4, "alpha beta gamma")]
    items = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")

    def near(slop):
        return {r["id"]: (r["n_hit"], r["n_near"]) for i in rows for r in
                d.search(d.build_index(docs([i])), items, slop=slop).collect()}

    assert near(0) == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (3, 1)}
    assert near(1) == {1: (0, 1), 2: (0, 0), 3: (0, 0), 4: (3, 1)}
    assert near(2)[2] == (0, 1)


def test_parts_are_written_one_by_one(docs, spark, monkeypatch):
    steps, make, write = [], d.Windows, d.cut
    monkeypatch.setattr(d, "Windows", lambda *a: steps.append("windows") or make(*a))
    monkeypatch.setattr(d, "cut", lambda df, name: steps.append(name) or write(df, name))
    rows = [(k, f"x{k} y z") for k in range(6)]
    items = spark.createDataFrame(rows[:3], "item_id long, text string")
    found = d.search(d.build_index(docs(rows)), items, part_words=1)
    assert steps == ["positional-index"] + ["windows", "hits"] * 3
    assert {r["id"]: (r["n_hit"], r["items"]) for r in found.collect()} == {
        k: (3, [str(k)]) if k < 3 else (0, []) for k in range(6)}


def test_matches_belong_to_their_documents(docs, spark):
    rows = [(1, "alpha x beta gamma"), (2, "clean words here"), (3, "one alpha beta gamma"), (4, "alpha"), (5, "beta gamma")]
    items = spark.createDataFrame([(9, "alpha beta gamma"), (8, "alpha beta gamma")], "item_id long, text string")
    index = d.build_index(docs(rows))
    one = d.build_index(docs(rows).coalesce(1))
    assert one.count() == 1
    for i in (index, one):
        assert {r["id"]: (r["n_hit"], r["n_near"]) for r in d.search(i, items, slop=1).collect()} == {
            1: (0, 1), 2: (0, 0), 3: (3, 1), 4: (0, 0), 5: (0, 0)}
        got = {(r["id"], r["item"], r["window"], r["place"], r["kind"]) for r in d.matches(i, items, slop=1).collect()}
        assert got == {(n, item, 0, place, kind) for item in "89"
                       for n, place, kind in ((3, 1, "exact"), (3, 1, "near"), (1, 0, "near"))}
    assert d.matches(one, items.limit(0)).collect() == []
    # Which word is rarest in a block changes nothing.
    rows = [(1, "alpha x beta x gamma"), (2, "alpha alpha gamma gamma")]
    for r in (rows, rows[:1]):
        assert d.matches(d.build_index(docs(r).coalesce(1)), items, slop=1).collect() == []


def test_stage_drops_by_row(docs, spark):
    passage = " ".join(f"q{k}" for k in range(20))
    rows = [(1, passage), (1, "clean words"), (None, passage + " more"), (None, "clean"), (2, passage + " z" * 600), (3, None)]
    kept = d.drop_contaminated(docs(rows), spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.columns == docs(rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(1, "clean words"), (None, "clean"), rows[4], (3, None)], key=str)


def test_stage_leaves_columns_of_any_name_alone(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    names = ["__mark", "_llm_mark", "mark", "id"]
    rows = [(k, t, *[f"{n} of {k}" for n in names]) for k, t in ((1, passage), (2, "clean text"), (None, None))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = d.drop_contaminated(frame, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
