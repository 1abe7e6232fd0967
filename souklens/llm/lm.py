"""Stupid-backoff language-model scores (operator 8).

The counts of all n-grams of the corpus (orders 1 to ``ORDER``) meet the n-grams of every document by hash:

1. Documents are gathered into blocks of some 1,000,000 words; a block keeps its own dictionary and its words as numbers,
   the frequent ones small.  Larger blocks share more of their n-grams and lie closer, so less is moved.
2. Every block gives its distinct n-grams with their counts, cut by the upper bits of the n-gram's 56-bit hash into
   partitions of the count table: one row for each block and partition.  Counting within the block first means that an
   n-gram of a third of all documents is one entry of each block.
3. Each partition adds up the counts of its n-grams and answers every block with the totals of that block's n-grams.
4. A block with its answers scores its documents.  A document's own occurrences are taken off the counts, so that a text
   is never scored by itself.

Hashes have 56 bits: of 10^9 distinct n-grams some 10 share a hash with another, of 10^13 some 10^9, a ten-thousandth.

The score of a word is count(n-gram) / count(context) at the longest order where the n-gram is known, times 0.4 for each
order that was left out; a word unknown to all other documents counts as one occurrence.  Words are those of
``alnum_words``; contexts do not reach over a document's start.  A document's score is the sum of the logarithms.

Defined cases: null and empty texts, and texts without words, have n_words 0, log_score 0 and mean null.  With a single
document every word is unknown.  Repeated rows are documents of their own and know each other.  Rows without doc_id are
scored like any other.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.llm.storage import cut
from souklens.llm.text import Interner, alnum_words, chunks, ngram_hashes

ORDER = 3
BACKOFF = 0.4
BLOCK_WORDS = 1_000_000
HASH_BITS = 56
PARTITION_GRAMS = 2_000_000
_SALT = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63],
                 np.uint64)


def word_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, ids, sizes, terms, numbers): documents as packed numbers into the block's own dictionary."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, sizes, numbers, terms, total = [], [], [], Interner(), 0

        def row() -> pa.RecordBatch:
            nonlocal made, ids, sizes, numbers, terms, total
            words = np.concatenate(numbers)
            order = np.argsort(-np.bincount(words, minlength=len(terms)), kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            named = list(terms)
            out = pa.record_batch(
                [pa.array([(part << 32) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([pack(b" ".join(named[k] for k in order))], pa.binary()),
                 pa.array([pack_numbers(rank[words])], pa.binary())],
                ["block", "ids", "sizes", "terms", "numbers"])
            made, ids, sizes, numbers, terms, total = made + 1, [], [], [], Interner(), 0
            return out

        for piece, texts in chunks(batches, "text", 1 << 20):
            for d, t in zip(piece.column(0).to_pylist(), texts):
                words = alnum_words(t)
                if ids and total + len(words) > block_words:
                    yield row()
                ids.append(d)
                sizes.append(len(words))
                numbers.append(terms.numbers(words))
                total += len(words)
        if ids:
            yield row()

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        make, "block long, ids array<long>, sizes array<long>, terms binary, numbers binary"), "word-blocks")


class Grams:
    """The n-grams of one block: for each order the hash of the n-gram that ends at each word, and its document."""

    def __init__(self, sizes: list[int], terms: bytes, numbers: bytes, order: int):
        self.sizes = np.array(sizes, np.int64)
        table = np.array([xxhash.xxh3_64_intdigest(w) for w in unpack(terms).split()], np.uint64)
        words = table[unpack_numbers(numbers).astype(np.int64)]
        self.document = np.repeat(np.arange(len(sizes)), self.sizes)
        self.depth = np.arange(len(words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.order, self.words = order, words

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(last word's place, hash) of each n-gram within a document."""
        at = np.flatnonzero(self.depth >= n - 1)
        return at, (ngram_hashes(self.words, n)[at - n + 1] ^ _SALT[n]) >> np.uint64(64 - HASH_BITS)


def _bucket_bounds(bits: int) -> np.ndarray:
    return np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(HASH_BITS - bits) if bits else np.zeros(0, np.uint64)


def pack(data: bytes) -> bytes:
    """Bytes compressed, behind their length."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unpack(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True) if size else b""


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, lowest bytes first, as many as the largest needs: the upper planes are almost
    empty, so compression leaves little of them."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + pack(np.ascontiguousarray(planes).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as their differences: most need fewer bytes than the largest, so planes cost less."""
    return int(values[0]).to_bytes(8, "little") + pack_numbers(np.diff(values)) if len(values) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1), unpack_numbers(data[8:])]), dtype=np.uint64)


def stupid_backoff(docs: DataFrame, order: int = ORDER, block_words: int = BLOCK_WORDS,
                   partition_grams: int = PARTITION_GRAMS) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for every row of ``docs(doc_id, text)``."""
    blocks = word_blocks(docs, block_words)
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).first()["n"] or 0
    bits = max(3, (order * total // partition_grams).bit_length())
    bounds = _bucket_bounds(bits)

    def distinct(grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([grams.hashes(n)[1] for n in range(1, order + 1)]), return_counts=True)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                grams, counts = distinct(Grams(r["sizes"], r["terms"], r["numbers"], order))
                cuts = np.concatenate([[0], np.searchsorted(grams, bounds), [len(grams)]]).tolist()
                yield pa.record_batch(
                    [pa.array(range(len(cuts) - 1), pa.int32()), pa.array([r["block"]] * (len(cuts) - 1), pa.int64()),
                     pa.array([pack_sorted(grams[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                     pa.array([pack_numbers(counts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    ["bucket", "block", "grams", "counts"])

    def add(table: pa.Table) -> pa.Table:
        grams = [unpack_sorted(x) for x in table.column("grams").to_pylist()]
        counts = [unpack_numbers(x) for x in table.column("counts").to_pylist()]
        all_, where = np.unique(np.concatenate(grams), return_inverse=True)
        sums = np.bincount(where, np.concatenate(counts), len(all_)).astype("<u8")
        ends = np.cumsum([len(g) for g in grams])
        answers = [pack_numbers(sums[w]) for w in np.split(where, ends[:-1])]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "totals": pa.array(answers, pa.binary())})

    answers = (blocks.select("block", "sizes", "terms", "numbers")
               .mapInArrow(give, "bucket int, block long, grams binary, counts binary")
               .groupBy("bucket").applyInArrow(add, "block long, bucket int, totals binary"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        r = left.to_pylist()[0]
        grams = Grams(r["sizes"], r["terms"], r["numbers"], order)
        known = distinct(grams)[0]
        told = sorted(zip(right.column("bucket").to_pylist(), right.column("totals").to_pylist()))
        sums = np.concatenate([unpack_numbers(t) for _, t in told]).astype(np.int64)
        n = len(grams.words)
        others = np.zeros((order + 1, n), np.int64)  # occurrences in other documents, by order and last word
        for k in range(1, order + 1):
            at, h = grams.hashes(k)
            place = np.searchsorted(known, h)
            pairs, inverse, own = np.unique(grams.document[at] * len(known) + place, return_inverse=True, return_counts=True)
            others[k, at] = sums[place] - own[inverse]
        others[0] = total - np.repeat(grams.sizes, grams.sizes)
        log, open_ = np.zeros(n), np.ones(n, bool)
        for k in range(order, 0, -1):
            # The context of an n-gram that ends here is the shorter n-gram that ends one word earlier.
            before = others[0] if k == 1 else np.concatenate([[0], others[k - 1, :-1]])
            fits = open_ & (grams.depth >= k - 1) & (others[k] > 0)
            log[fits] += np.log(others[k][fits] / before[fits])
            open_ &= ~fits
            if k > 1:
                log[open_ & (grams.depth >= k - 1)] += np.log(BACKOFF)
        log[open_] -= np.log(np.maximum(others[0][open_], 1))
        sums_of = np.bincount(grams.document, log, len(grams.sizes))
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = sums_of / grams.sizes
        return pa.table({"doc_id": pa.array(r["ids"], pa.int64()), "n_words": pa.array(grams.sizes),
                         "log_score": pa.array(sums_of),
                         "mean_log_score": pa.array(mean, mask=grams.sizes == 0)})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score, "doc_id long, n_words long, log_score double, mean_log_score double")


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", F.round("mean_log_score", 4).alias("mean_log_score"))
