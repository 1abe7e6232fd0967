"""Token ids of whole texts, with a public tokenizer file."""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable
from itertools import count, islice, repeat

import numpy as np

END_ID = 2
WORD_FILE = "word_bpe_49k.json"
# Letters that lower-casing and normalisation leave alone or map one to one, then ASCII marks without the apostrophe
# (which starts contractions): such a word is one piece of letters and one piece of marks.
_PLAIN_LINES = re.compile("(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)|([^\n]*))\n")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_FILE)


def _byte_chars() -> list[str]:
    """The character that byte-level vocabularies use for each byte: printable Latin-1 stands for itself, the others
    follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    up = {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chr(b) if b in plain else up[b] for b in range(256)]


class _Table:
    """Words and their ids.  ``numbers`` gives each word its number, in order of first use."""

    def __init__(self):
        self.numbers = defaultdict(count().__next__)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def of(self, texts: Iterable[list]) -> tuple[list[np.ndarray], list]:
        """The numbers of each text's words, and the words that are new, whose ids ``put`` has to add."""
        before = len(self.numbers)
        numbers = [np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)) for words in texts]
        return numbers, list(islice(reversed(self.numbers), len(self.numbers) - before))[::-1]

    def put(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add the ids of the words with these numbers, one after the other."""
        if len(self.numbers) > len(self.first):
            self.first, self.count = (np.resize(x, 2 * len(self.numbers)) for x in (self.first, self.count))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used:self.used + len(ids)] = ids
        self.count[numbers] = sizes
        self.first[numbers] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words with these numbers, one after the other, and how many each has."""
        sizes = self.count[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.first[numbers] - ends + sizes, sizes) + np.arange(sizes.sum())], sizes


class Encoder:
    """``encode_batch`` of a tokenizer, faster for files whose pieces never span white space.

    Where the file drops white space and splits at it, the ids of a text are those of its white-space separated words
    one after the other, so each distinct word is encoded once and then looked up.  Other files use plain
    ``encode_batch``.  A table of ``most`` words becomes the old one and is asked once more for each of its words, so
    frequent words stay; this bounds memory and changes no id."""

    def __init__(self, path: str | None = None, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = path or default_path()
        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        with open(path, encoding="utf-8") as f:
            self.by_word = _splits_at_space(json.load(f))
        self.chars = _byte_chars()
        self.now, self.old, self.pieces = _Table(), _Table(), _Table()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) in order and the number of ids of each text."""
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts],
                                                              add_special_tokens=False)]
            sizes = np.array([len(i) for i in ids], np.int64)
            return np.array([x for i in ids for x in i], np.uint32), sizes
        if len(self.now.numbers) > self.most:
            self.now, self.old = _Table(), self.now
        if len(self.pieces.numbers) > self.most:
            self.pieces = _Table()
        collecting = gc.isenabled()
        gc.disable()  # many small objects and no cycles: the collector would only walk the tables
        try:
            numbers, new = self.now.of(map(bytes.split, texts))
            if new:
                self._add(new)
        finally:
            if collecting:
                gc.enable()
        ids, sizes = self.now.get(np.concatenate([np.zeros(0, np.int64), *numbers]))
        ends = np.cumsum([0] + [len(n) for n in numbers])
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends])

    def _add(self, new: list[bytes]) -> None:
        """Add the newest words to the table: those of the old table with their ids, the others by their pieces."""
        at = np.arange(len(self.now.numbers) - len(new), len(self.now.numbers))
        known = np.fromiter(map(self.old.numbers.get, new, repeat(-1)), np.int64, len(new))
        self.now.put(at[known >= 0], *self.old.get(known[known >= 0]))
        at = at[known < 0]
        lines = b"\n".join([*(w for w, k in zip(new, known.tolist()) if k < 0), b""]).decode("utf-8", "replace")
        found = _PLAIN_LINES.findall(lines)
        plain = np.fromiter((bool(f[0]) for f in found), bool, len(found))
        letters = "\n".join([f[0] for f in found if f[0]]).lower().split("\n") if plain.any() else []
        # a word's letters and its marks (which may be none) stand next to each other
        both = [""] * (2 * len(letters))
        both[::2], both[1::2] = letters, [f[1] for f in found if f[0]]
        (numbers,), pieces = self.pieces.of([both])
        self._add_pieces(pieces)
        ids, sizes = self.pieces.get(numbers)
        self.now.put(at[plain], ids, sizes.reshape(-1, 2).sum(1))
        ids = self._encode([f[2] for f in found if not f[0]])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.now.put(at[~plain], np.frombuffer(b"".join(ids), np.uint32), sizes)

    def _add_pieces(self, pieces: list[str]) -> None:
        tokenize, ids, ends = self.tokenizer.model.tokenize, array("I"), [0]
        for p in pieces:
            chars = p if p.isascii() else "".join(map(self.chars.__getitem__, p.encode()))
            ids.extend([t.id for t in tokenize(chars)])
            ends.append(len(ids))
        n = len(self.pieces.numbers)
        self.pieces.put(np.arange(n - len(pieces), n), np.frombuffer(ids, np.uint32), np.diff(ends))

    def _encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word, by the whole tokenizer."""
        out = []
        for at in range(0, len(words), 2_000):
            some = words[at:at + 2_000]
            starts = np.cumsum([0] + [len(t) + 1 for t in some])
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            word = np.searchsorted(starts, [a for a, _ in got.offsets], "right") - 1
            ends, ids = np.searchsorted(word, np.arange(len(some)), "right").tolist(), got.ids
            out += [array("I", ids[a:b]).tobytes() for a, b in zip([0, *ends], ends)]
        return out


def _splits_at_space(spec: dict) -> bool:
    """Whether the file is of the kind that the lookup is right for: NFC, white space to one space, lower case, then
    pieces that leave white space out, by byte."""
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("type") == "Split"
            and steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert"))
            and str(steps[0].get("pattern", {}).get("Regex", "")).endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex") and spec.get("model", {}).get("type") == "BPE")


_encoders: dict = {}


def encoder(path: str | None) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
