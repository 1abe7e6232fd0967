import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from souklens.llm import addressable, packing, tokens


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokens.default_path())


ENCODER = tokens.Encoder()
ALPHABET = "abcXYZ  \t\n.,!?'\"-_*%$&#@|0123456789éÉßñÑçøÀÿ×÷ªºµİıſΣσςẞ́　  \x1c漢字😀<|endoftext|>"


def same(plain, texts):
    ids, sizes = ENCODER([t.encode() for t in texts])
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want], texts
    assert ids.tolist() == [i for w in want for i in w], texts


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=40), max_size=6))
def test_lookup_equals_encoding_of_whole_texts(texts):
    same(Tokenizer.from_file(tokens.default_path()) if not hasattr(same, "t") else same.t, texts)


same.t = Tokenizer.from_file(tokens.default_path())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(same.t, [text.encode("utf-8", "ignore").decode()])


def test_special_strings_and_test_table(spark, plain):
    same(plain, ["a<|endoftext|>b", "<|startoftext|> x", "don't we'll 'S I'M", "a" * 5000, "", " \n "])
    same(plain, [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])


def test_tables_start_anew(plain):
    small = tokens.Encoder(most=10)
    for _ in range(3):
        texts = [" ".join(random.Random(k).choices("abcdefghij", k=9)) + f" z{k}" for k in range(40)]
        ids, _ = small([t.encode() for t in texts])
        assert ids.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids]


def test_letters_are_cut_once_whatever_marks_and_case_they_stand_with():
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.model, self.asked = tokenizer, self, []

        def tokenize(self, text):
            self.asked.append(text)
            return self.tokenizer.model.tokenize(text)

    e = tokens.Encoder(most=10)
    e.tokenizer = Counting(e.tokenizer)
    for k in range(5):  # the table of words starts anew in between, that of the pieces does not
        e([f"Word{'!' * k} word{',' * k} WORD".encode()])
    assert e.tokenizer.asked.count("word") == 1


def test_other_files_are_encoded_plainly():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, reference = tokens.Encoder(path), Tokenizer.from_file(path)
    assert not other.by_word
    ids, sizes = other([b"a  b c", b""])
    assert ids.tolist() == reference.encode("a  b c", add_special_tokens=False).ids and sizes.tolist()[1] == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=3000), st.data())
def test_codes_round_trip(numbers, data):
    codes = addressable.Codes(addressable.Codes.encode(np.array(numbers, np.uint32)))
    assert len(codes) == len(numbers)
    assert codes.read(0, len(numbers)).tolist() == numbers
    a = data.draw(st.integers(0, len(numbers)))
    b = data.draw(st.integers(a, len(numbers)))
    assert codes.read(a, b).tolist() == numbers[a:b]
    for k in range(0, len(numbers), 97):
        assert codes[k] == numbers[k]


def ids_of(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ROWS = [(5, "some words here"), (1, None), (3, ""), (3, "repeated"), (3, "repeated"), (None, "no id"), (9, "long " * 20_000),
        *[(100 + k, "tail " * k) for k in range(60)]]


def test_written_files_read_back(docs, spark, tmp_path, plain, monkeypatch):
    monkeypatch.setattr(addressable, "SEGMENT", 500)
    path = f"{tmp_path}/codes"
    addressable.write_tokens(docs(ROWS), path, segment=500)
    got = sorted(addressable.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == sorted(
        (str(i), np.array(ids_of(plain, t), "<u4").tobytes()) for i, t in ROWS)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    addressable.write_tokens(docs([]), f"{tmp_path}/none")
    assert addressable.read_tokens(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("pushed", [1_000, 3])
def test_single_tokens_equal_a_full_read(spark, docs, tmp_path, monkeypatch, pushed):
    monkeypatch.setattr(addressable, "SEGMENT", 64)
    path = f"{tmp_path}/codes"
    addressable.write_tokens(docs([(k, "some words of a text " * (1 + k % 40)) for k in range(60)] + ROWS), path, segment=64)
    rows = sorted(addressable.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    every = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows])
    wanted = [0, 1, 63, 64, 65, len(every) - 1, *range(100, len(every), 97), len(every), len(every) + 10 ** 9, -1, None, 0]
    places = spark.createDataFrame([(w, "x", 1) for w in wanted], "place long, codes string, part int")
    got = {r["place"]: r["id"] for r in addressable.tokens_at(spark, path, places, pushed).collect()}
    assert got == {w: int(every[w]) for w in wanted if w is not None and 0 <= w < len(every)}
    assert addressable.tokens_at(spark, path, places.limit(0), pushed).collect() == []


def test_a_search_for_one_token_opens_one_page(spark, docs, tmp_path):
    """The page index holds each segment's numbers, the pages are not compressed, and the scan gets the filter."""
    import pyarrow.parquet as pq

    path = tmp_path / "codes"
    addressable.write_tokens(docs([(k, "words " * 300) for k in range(200)]).coalesce(1), str(path), segment=1_000)
    for f in path.glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        column = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == "codes")
        assert column.compression == "UNCOMPRESSED" and column.has_offset_index
    one = spark.createDataFrame([(12_345,)], "place long")
    plan = addressable.tokens_at(spark, str(path), one)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(segment," in plan or "In(segment," in plan


def test_addressable_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in addressable.op4_addressable_codes(spark, sf).collect()}
    at = 0
    for i, t in texts:
        ids = ids_of(plain, t)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def check_pieces(pieces, rows, plain, size):
    want = sorted((str(i), crc(ids_of(plain, t))) for i, t in rows)
    by_sequence, whole = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r["length"] * 4 == len(r["ids"]) and r["length"] > 0
        by_sequence[r["sequence_id"]].append(r)
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        n = 0
        for r in parts:
            assert r["offset"] == n
            n += r["length"]
        assert n <= size
        padding += 0 if n & (n - 1) == 0 else size - n
    assert padding == 0
    for r in sorted(pieces, key=lambda r: (str(r["doc_id"]), r["doc_tokens"], r["start"])):
        whole[r["doc_id"], r["doc_tokens"], zlib.crc32(bytes(r["ids"])) if False else None].append(r)
    # Repeated rows have equal pieces only in sum: compare the multiset of ids per document id.
    got, need = defaultdict(int), defaultdict(int)
    for r in pieces:
        got[r["doc_id"]] += r["length"]
    for i, t in rows:
        need[i] += len(ids_of(plain, t))
    assert got == need
    return want


def test_packing(docs, plain):
    rows = ROWS + [(1000 + k, " ".join(["word"] * random.Random(k).randint(1, 700))) for k in range(300)]
    for size, most in ((4096, 2048), (256, 10)):
        pieces = packing.pack(docs(rows), size=size, most_open=most).collect()
        check_pieces(pieces, rows, plain, size)
        unique = {i: t for i, t in rows if i not in (3,)}
        by = defaultdict(list)
        for r in pieces:
            by[r["doc_id"]].append(r)
        for i, t in unique.items():
            parts, at = sorted(by[i], key=lambda r: r["start"]), 0
            for r in parts:
                assert r["start"] == at and r["doc_tokens"] == len(ids_of(plain, t))
                at += r["length"]
            assert b"".join(bytes(r["ids"]) for r in parts) == np.array(ids_of(plain, t), "<u4").tobytes()
    assert packing.pack(docs([])).collect() == []


def test_level_choice_is_the_least_sum_of_squares():
    rng = random.Random(1)
    packer = packing.SumOfSquares(64)
    for _ in range(3000):
        n = rng.randint(1, 63)
        c = packer.levels.copy()

        def squares(h):
            x = c.copy()
            if h:
                x[h] -= 1
            if h + n < 64:
                x[h + n] += 1
            return int((x * x).sum())

        options = {h: squares(h) for h in range(0, 65 - n) if h == 0 or c[h]}
        assert options[packer.level_for(n)] == min(options.values())
        for window in packer.place(0, np.zeros(n, np.uint32)):
            assert sum(len(p[2]) for p in window) == 64
        assert packer.levels.sum() == packer.open_now == sum(len(w) for w in packer.windows.values())


def test_packing_query_has_whole_documents(spark, plain):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total = defaultdict(int)
    for r in packing.op7_sum_of_squares(spark, sf).collect():
        total[r["doc_id"]] += r["length"]
        ids = ids_of(plain, texts[r["doc_id"]])
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"]:r["start"] + r["length"]])
    assert total == {i: len(ids_of(plain, t)) for i, t in texts.items()}
