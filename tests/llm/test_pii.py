import hashlib
import random
import re

from souklens.llm import pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    total = 0
    for k, c in enumerate(reversed(s)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns_on_random_texts():
    rng = random.Random(5)
    parts = ["a@b.c", "@", "+", "1", "22", "333", ".", "-", " ", "(", ")", "x.y@z-1.com.", "+1 (269) 555-3296", "10.0.0.1",
             "256.1.1.1", "4349000490986231", "4349 0004 9098 6231", "é", "\n", "😀", "..", "%", "a", "http://u@h.com", "IBAN "]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        got = [(pii.KINDS[k], a, b) for k, a, b in pii.find_spans(text)[0]]
        assert got == brute(text), text


def test_added_spans_split_what_stands_together():
    text = "call +1 (269) 555-3296 4524132264652876 now"
    base, added = pii.find_spans(text)
    assert base == []
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in added] == [("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")]
    text = "see https://bob:pw@host.example/x and IBAN GB82 WEST 1234 5698 7654 32, account no: 12345678."
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find_spans(text)[1]] == [
        ("url", "https://bob:pw@host.example/x"), ("account", "GB82 WEST 1234 5698 7654 32"),
        ("account", "12345678")]


def test_account_numbers_up_to_the_end_of_the_sentence():
    de, gb = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"

    def found(text):
        return [text[a:b] for k, a, b in pii.find_spans(text)[1] if pii.KINDS[k] == "account"]

    assert found("IBAN DE89370400440532013000 BIC COBADEFFXXX") == ["DE89370400440532013000"]
    assert found(f"IBAN: {de} EUR 500") == [de]
    assert found(f"IBAN for wire transfers to our bank: {de}") == [de]
    assert found(f"IBAN {de} or {gb}, BIC X") == [de, gb]
    assert found(f"account no. 12345678, IBAN {gb}.") == ["12345678", gb]
    assert found(f"account 12345678 or {de}") == ["12345678", de]
    assert found(f"IBAN:\n{de}\nIBAN No. {gb}") == [de, gb]
    assert found(f"The account of the whole of our small company at the bank (Fa. Moritz und Sohn): {de}") == [de]
    far = " and so on, as is usual among friends of long words and many lines"
    assert found(f"Use the IBAN.{far}\nCODE {de}") == []
    assert found(f"IBAN {de}x") == []
    assert found("IBAN " + "DE89 " * 20_000) == []


def test_long_runs_of_digits_and_marks():
    assert pii.find_spans("9" * 50_000)[0] == []
    assert pii.find_spans("1." * 20_000)[0] == [(1, 8 * k, 8 * k + 7) for k in range(4_999)] + [(1, 39_992, 39_999)]
    assert pii.find_spans("a" * 50_000 + "@")[0] == []
    assert pii.find_spans("+" * 10_000) == ([], [])


def test_query_columns_nulls_and_repeated_rows(spark, docs, tmp_path):
    rows = [(1, "mail a@b.co"), (1, "mail a@b.co"), (2, None), (3, ""), (None, "ip 1.2.3.4")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op1_anchor_expansion(spark, str(tmp_path)).collect()
    assert len(got) == 5
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_email"] == 1 and by[1]["spans"] == "email:5:11"
    assert by[1]["base_sha256"] == hashlib.sha256(b"email:5:11").hexdigest()
    assert by[2]["spans"] == by[3]["spans"] == "" and by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[None]["n_ip"] == 1
    assert pii.op1_anchor_expansion(spark, str(tmp_path)).limit(0).count() == 0


def test_whole_table_against_the_patterns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op1_anchor_expansion(spark, sf).collect():
        base = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))


def test_redaction(docs):
    rows = [(1, "mail a@b.co now"), (2, None), (3, ""), (4, "clean text"), (5, "+1 (269) 555-3296 4524132264652876")]
    got = {r["doc_id"]: r for r in pii.redact_personal_data(docs(rows)).collect()}
    assert got[1]["text"] == "mail [EMAIL] now" and got[1]["n_chars"] == len("mail [EMAIL] now")
    assert got[2]["text"] is None and got[3]["text"] == "" and got[4]["text"] == "clean text"
    assert got[5]["text"] == "[PHONE] [CARD]"
    assert pii.redact_personal_data(docs([])).collect() == []
