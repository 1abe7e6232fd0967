"""Personal data by anchor expansion (operator 1).

An Aho-Corasick automaton runs over the whole text and stops only at anchors: at-signs, plus signs, digits, schemes and
account cues.  From each anchor a local parser expands to the left and right and validates what it finds.

Base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns, failing ones dropped.
Added spans are what the anchors find beyond that:
* phone, card: where a base match failed because numbers stand next to each other, the longest run of whole digit groups
  with 8 to 15 digits after the plus sign, and runs of whole groups with 16 to 19 digits that pass the Luhn check;
* url: addresses with a scheme that carry a user name before the host;
* account: digits that follow an account cue, and the international account numbers that start before the end of the
  cue's sentence or line or the next cue (49 characters at least): from each place where one may start, the longest run of
  whole groups that passes the mod-97 check.

Defined cases: a null text is an empty text without spans; each row is judged alone, so repeated rows get equal results;
other columns pass through.  Ends are exclusive; places count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s/?#@<>\"']+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s<>\"']*")
_IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}")
_GROUP = re.compile(r"[A-Z0-9]{1,34}(?![A-Za-z0-9])")
_NEXT_CUE = re.compile(rf"(?<![^\W_])(?:{'|'.join(f for c in CUES for f in (c, c.capitalize(), c.upper()))})")
# No end of a sentence: a point after a short word (no., nr., Fa.) or before an account number.
_END = re.compile(r"[\n\r]|(?:[!?]|(?<!\b\w)(?<!\b\w\w)(?<!\b\w\w\w)\.)(?=\s+(?![A-Z]{2}[0-9]{2})[^\W\d_a-z])")
_AFTER_CUE = re.compile(r"(?:[ \t]*(?:number|nr|no|num|n°)\.?)?[ \t]*[:#=]?[ \t]*([0-9](?:[ -]?[0-9]){5,33})(?![0-9])", re.I)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        for form in {c, c.capitalize(), c.upper()}:
            a.add_word(form, ("cue", len(c)))
    a.make_automaton()
    return a


AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _quad(parts: tuple[str, ...]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Account numbers that start in the range, leftmost and longest first."""
    at = start
    while (m := _IBAN_START.search(text, at, end + 3)) and m.start() < end:
        best, size, to = None, 0, m.start()
        while size <= 34 and (g := _GROUP.match(text, to)):
            size += g.end() - g.start()
            if 15 <= size <= 34 and _iban(text[m.start():g.end()]):
                best = g.end()
            to = g.end() + 1
            if text[g.end():to] != " ":
                break
        if best:
            yield m.start(), best
        at = best or m.start() + 1


def _split_cards(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of whole groups of a failed card match that are card numbers, leftmost and longest first."""
    groups = [(m.start(), m.end()) for m in _DIGITS.finditer(text, start, end)]
    i = 0
    while i < len(groups):
        size, best = 0, None
        for j in range(i, len(groups)):
            size += groups[j][1] - groups[j][0]
            if size > 19:
                break
            if size >= 16 and luhn("".join(text[a:b] for a, b in groups[i:j + 1])):
                best = j
        if best is None:
            i += 1
        else:
            yield groups[i][0], groups[best][1]
            i = best + 1


def _cut_phone(text: str, start: int, end: int) -> int | None:
    """The end of the longest run of whole groups with 8 to 15 digits."""
    size, best = 0, None
    for m in _DIGITS.finditer(text, start, end):
        size += m.end() - m.start()
        if size > 15:
            break
        if size >= 8:
            best = m.end()
    return best


def find_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans, each (kind number, start, end) in order."""
    base, added = [], []
    email = card = ip = phone = url = 0
    for last, (what, size) in AUTOMATON.iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= ip:
                if m := _QUAD.match(text, at):
                    ip = m.end()
                    if _quad(m.groups()):
                        base.append((1, at, ip))
                else:
                    ip = _DIGITS.match(text, at).end()
            if at >= card:
                if m := _CARD.match(text, at):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        base.append((2, at, card))
                    elif len(digits) > 16:
                        added += ((2, a, b) for a, b in _split_cards(text, at, card))
                else:
                    card = at + 1
        elif what == "at":
            start = at
            while start > email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                base.append((0, start, email))
        elif what == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                n = sum(map(str.isdigit, m[0]))
                if 8 <= n <= 15:
                    base.append((3, at, phone))
                elif n > 15 and (end := _cut_phone(text, at, phone)):
                    added.append((3, at, end))
        elif what == "scheme":
            if at >= url and (m := _URL.match(text, last + 1)):
                url = m.end()
                added.append((4, at, url))
        elif not (at and text[at - 1].isalnum()):
            if m := _AFTER_CUE.match(text, last + 1):
                added.append((5, m.start(1), m.end(1)))
            cue = m.start() if (m := _NEXT_CUE.search(text, last + 1)) else len(text)
            end = m.start() if (m := _END.search(text, last + 1, cue)) else cue
            added += ((5, a, b) for a, b in _ibans(text, last + 1, max(end, last + 50)))
    return sorted(base), sorted(set(added))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span becomes its kind in brackets; of spans that overlap, the first and longest names the whole."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if merged and a < merged[-1][1]:
            if b > merged[-1][1]:
                merged[-1][1] = b
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += (text[at:a], f"[{KINDS[k].upper()}]")
        at = b
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row: arrays of ``struct(kind, start, end)``, by kind as listed, then start."""
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def named(spans):
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([named(b) for b, _ in found], item),
                                   pa.array([named(sorted({*b, *a})) for b, a in found], item)],
                                  ["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, base {spans}, spans {spans}")


def redact_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind and, where there is one, ``n_chars`` counted anew."""
    place = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = batch.column(place).to_pylist()
            new = [t and redact(t, [s for part in find_spans(t) for s in part]) for t in texts]
            columns[place] = pa.array(new, batch.schema.field(place).type)
            if size is not None:
                old = batch.column(size).to_pylist()
                columns[size] = pa.array([n if a == b else len(b) for n, a, b in zip(old, texts, new)],
                                         batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)


def op1_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, BASE), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))
