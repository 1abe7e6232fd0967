import random

import pytest

from souklens.llm import minhash
from souklens.llm.components import connected_components


def shingles(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(k)
    for k, (i, s) in enumerate(sets):
        near = {m for g in s for m in index[g] if m < k}
        for m in near:
            j, t = sets[m]
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_planted_groups_against_brute_force(docs):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([4, 6, 40, 200, 400]))
        for _ in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, len(t) // 30])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((n, rng.choice([" ", "\t", "\n"]).join(t)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "A b"), (n + 4, "a B"), (n + 5, "a b")]
    rng.shuffle(rows)
    check(minhash.near_duplicates(docs(rows)).collect(), rows)


def test_large_group_of_near_copies_with_small_blocks(docs, monkeypatch):
    """A bucket larger than a block, whose smallest member links with few of the others."""
    monkeypatch.setattr(minhash, "BLOCK", 20)
    rng = random.Random(4)
    base = [f"x{k}" for k in range(120)]
    rows = []
    for n in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"y{rng.randrange(10_000)}"
        rows.append((n, " ".join(t)))
    check(minhash.near_duplicates(docs(rows)).collect(), rows)


def test_test_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(minhash.op2_minhash(spark, sf).collect(), rows)


def test_empty_null_and_repeated_ids(docs):
    assert minhash.near_duplicates(docs([])).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (3, None)]
    got = sorted(minhash.near_duplicates(docs(rows)).collect(), key=str)
    assert len(got) == 6
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {
        (1, 1, True), (2, 1, False), (None, 1, False), (None, None, False), (3, 3, True)}


def test_stage_keeps_one_row_of_each_group(docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (4, "other text here"), (5, None), (6, "")]
    kept = minhash.keep_one_each(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    assert minhash.keep_one_each(docs([])).collect() == []


def test_stage_with_rows_that_no_id_tells_apart(docs):
    a, b, near = "a b c d e f", "only null ids have this text", " ".join(f"n{k}" for k in range(200))
    rows = [(1, a), (None, a), (None, a), (None, b), (None, b), (None, near), (None, near + " more"), (None, None), (None, "")]
    kept = minhash.keep_one_each(docs(rows))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert len(got) == 5 and [g for g in got if g[0] == 1] == [(1, a)]
    texts = [t for i, t in got if i is None]
    assert texts.count(b) == 1 and texts.count(None) == 1 and texts.count("") == 1
    assert sum((t or "").startswith("n0") for t in texts) == 1


def test_texts_of_one_id_are_searched_one_by_one_and_reported_as_one(docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(200)) for x in "abc")
    rows = [(5, a), (5, b), (1, a + " more"), (2, b + " more"), (3, c), (None, b)]
    check = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(rows)).collect()}
    assert check == {(5, 1, False), (1, 1, True), (2, 1, False), (3, 3, True), (None, 1, False)}


def test_stage_keeps_different_texts_of_one_id(docs):
    near = " ".join(f"n{k}" for k in range(200))
    rows = [(1, "first text of this id"), (1, near), (2, near + " more"), (3, "a b c"), (3, "a b c"), (4, "first text of this id")]
    kept = sorted((r["doc_id"], r["text"]) for r in minhash.keep_one_each(docs(rows)).collect())
    assert kept == [(1, "first text of this id"), (1, near), (3, "a b c")]


def test_stage_leaves_columns_of_any_name_alone(spark):
    names = ["__a", "__b", "h1", "d", "no_id", "_llm_h1", "_llm_d", "component", "mark"]
    rows = [(k, t, *[f"{n} of {k}" for n in names]) for k, t in ((1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, " "), (None, " "))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = minhash.keep_one_each(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)


def test_intermediate_tables_leave_the_shared_folder(spark, docs):
    from pathlib import Path

    from souklens.llm.storage import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:")) / "llm"
    rows = [(k, f"word{k % 7} " * 6 + "a b c d e") for k in range(30)]
    before = set(folder.glob("*")) if folder.exists() else set()
    kept = minhash.keep_one_each(docs(rows))
    left = {p.name.rpartition("-")[0].rpartition("-")[0] or p.name for p in set(folder.glob("*")) - before}
    assert len(set(folder.glob("*")) - before) == 1, left
    assert kept.count() == 7
    found = minhash.near_duplicates(docs(rows))
    assert len(set(folder.glob("*")) - before) == 3  # the drop list, the signatures and the named classes
    assert found.count() == 30


def test_a_centre_with_many_partners_is_dealt_into_shares(docs, monkeypatch):
    monkeypatch.setattr(minhash, "SHARE", 7)
    base = [f"x{k}" for k in range(120)]
    rows = [(0, " ".join(base))] + [(n, " ".join(base[:n % 110] + [f"y{n}"] + base[n % 110 + 1:])) for n in range(1, 90)]
    check(minhash.near_duplicates(docs(rows)).collect(), rows)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 200)],
                                   [(5, 3), (3, 5), (9, 7), (7, 8), (20, 21), (8, 20)]])
def test_components(spark, edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(x, find(x)) for x in list(root)}
    assert len(got) == len(root)
