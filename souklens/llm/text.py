"""Words and word hashes of whole texts, in batches of numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
# Runs of these bytes are words in the benchmark contract: digits, lower-case letters, everything beyond ASCII.
ALNUM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))
_K = np.uint64(0x9E3779B97F4A7C15)
_FULL, _SHORT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def space_words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at the ASCII white space characters (x20, x09-x0D)."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and splits at every ASCII character that is neither a digit nor a letter."""
    return text.translate(ALNUM_TABLE).split()


class Interner(dict):
    """word -> number in order of first use."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class WordHashes:
    """64-bit hashes of words, kept for words met again.  The table starts anew at ``most`` words, which bounds memory
    and changes no hash."""

    def __init__(self, most: int = 400_000):
        self.most, self.known, self.table = most, Interner(), np.zeros(1024, np.uint64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known = Interner()
        before = len(self.known)
        numbers = self.known.numbers(words)
        after = len(self.known)
        if after > len(self.table):
            self.table = np.resize(self.table, 2 * after)
        if after > before:
            new = list(self.known)[before:] if before == 0 else _tail(self.known, after - before)
            self.table[before:after] = [xxhash.xxh3_64_intdigest(w) for w in new]
        return self.table[numbers]


def _tail(d: dict, n: int) -> list:
    it = reversed(d)
    return [next(it) for _ in range(n)][::-1]


def mix(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return x


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place (len(hashes) - n + 1 values)."""
    m = max(0, len(hashes) - n + 1)
    out = hashes[:m].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out *= _K
            out += hashes[k:k + m]
    return mix(out, _FULL)


def shingle_sets(texts: Iterable[bytes], hashes: WordHashes, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: ``size`` words each, the whole sequence where a text has fewer
    words, none where it has none."""
    words: list[bytes] = []
    counts = []
    for t in texts:
        w = space_words(t)
        words += w
        counts.append(len(w))
    h = hashes(words)
    every = ngram_hashes(h, size)
    out, at = [], 0
    for n in counts:
        if n >= size:
            out.append(np.unique(every[at:at + n - size + 1]))
        elif n:
            short = h[at:at + n]
            out.append(mix(ngram_hashes(short, n) + np.uint64(n), _SHORT))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``most_bytes`` of text each (one row at least), and their texts."""
    for batch in batches:
        texts = as_bytes(batch.column(batch.schema.get_field_index(column)))
        at, size = 0, 0
        for i, t in enumerate(texts):
            if i > at and size + len(t) > most_bytes:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t)
        if at < len(texts):
            yield batch.slice(at), texts[at:]


ASCII_SPACE = re.compile(rb"[\x20\x09-\x0D]+")
