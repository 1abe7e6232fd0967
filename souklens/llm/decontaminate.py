"""Benchmark decontamination with a distributed positional inverted index (operator 6).

``build_index`` stores the postings of every corpus word: documents are gathered into blocks of some 200,000 words, and
each block holds its own dictionary and, term after term, the ascending places of the term.  Blocks are rows of a Parquet
table in the shared folder, so a term that is in every document is spread over all blocks and no list grows with the
corpus.  ``search`` sends the test windows to all blocks: within a block a window with an absent word is dropped at once;
for the others the lists are taken from the rarest term on, shifted by the term's offset and intersected, which leaves
the exact phrases.  With ``slop`` it also finds proximity matches: occurrences of the window's first word (the anchor; the same
one in every block) around which every other word stands within ``slop`` words of its place, in the same document.  ``matches`` gives the exact
and proximity matches one by one, ``search`` their counts by document.

The test set is read in parts of bounded size (``PART_WORDS`` words).  Where there is more than one, each part is searched
and its hits are written before the next is made into windows, so at most two parts' texts and one part's windows are on the
driver and one part in the tasks; the written hits are merged by document.

Defined cases: null and empty texts have no words, match nothing and are never contaminated; items without words have no
window, an item with fewer than 13 words is one window.  Repeated items and repeated documents count one by one (equal
item ids once).  A test row without item_id hits like any other and is listed as the empty string.  An empty test set
leaves every document clean.  Columns other than those named are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.llm.storage import cut, free_name
from souklens.llm.text import Interner, alnum_words, chunks

WINDOW = 13
BLOCK_WORDS = 200_000
PART_WORDS = 1_000_000
INDEX = "ids array<long>, sizes array<long>, terms binary, counts binary, low binary, high binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each block of documents.  ``terms`` are the block's words, joined by spaces; ``counts`` (u4) their
    occurrences; ``low``/``high`` (u2) the halves of the places in the block, term by term."""
    def flush(ids: list, sizes: list, terms: Interner, numbers: list) -> pa.RecordBatch:
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        small = flat.astype(np.uint16) if len(terms) < 1 << 16 else flat
        places = np.argsort(small, kind="stable").astype(np.uint32)
        counts = np.bincount(flat, minlength=len(terms)).astype("<u4")
        return pa.record_batch(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
             *[pa.array([x], pa.binary()) for x in (b" ".join(terms), counts.tobytes(),
                                                    (places & 0xFFFF).astype("<u2").tobytes(),
                                                    (places >> 16).astype("<u2").tobytes())]],
            ["ids", "sizes", "terms", "counts", "low", "high"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, terms, numbers, total = [], [], Interner(), [], 0
        for part, texts in chunks(batches, "text", 1 << 20):
            for i, t in zip(part.column(0).to_pylist(), texts):
                words = alnum_words(t)
                if total and total + len(words) > block_words:
                    yield flush(ids, sizes, terms, numbers)
                    ids, sizes, terms, numbers, total = [], [], Interner(), [], 0
                ids.append(i)
                sizes.append(len(words))
                numbers.append(terms.numbers(words))
                total += len(words)
        if ids:
            yield flush(ids, sizes, terms, numbers)

    return cut(docs.select(F.col(id_col).cast("long").alias("id"), "text").mapInArrow(make, INDEX), "positional-index")


class Windows:
    """The distinct windows of a part of the test set."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        of = defaultdict(set)
        for item, text in items:
            words = alnum_words(text)
            for at in range(max(1, len(words) - size + 1) if words else 0):
                of[tuple(words[at:at + size])].add((item, at))
        terms = Interner()
        self.places = [sorted(v) for v in of.values()]      # (item, first word in it) of each window
        self.items = [sorted({i for i, _ in v}) for v in self.places]
        self.numbers = [terms.numbers(list(w)) for w in of]
        self.terms = list(terms)
        self.sizes = np.array([len(w) for w in self.numbers], np.int64)
        self.flat = np.concatenate(self.numbers) if self.numbers else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.int64)


class Block:
    """One stored block, open for search."""

    def __init__(self, sizes: list[int], terms: bytes, counts: bytes, low: bytes, high: bytes):
        self.terms = {w: n for n, w in enumerate(terms.split())}
        self.counts = np.frombuffer(counts, "<u4").astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        self.low, self.high = np.frombuffer(low, "<u2"), np.frombuffer(high, "<u2")
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def places(self, term: int) -> np.ndarray:
        a, b = self.at[term], self.at[term + 1]
        return self.low[a:b].astype(np.int64) | (self.high[a:b].astype(np.int64) << 16)

    def search(self, windows: Windows, slop: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(window, first places of its occurrences, anchors of its proximity matches) where there are any."""
        if not windows.numbers:
            return
        local = np.array([self.terms.get(w, -1) for w in windows.terms], np.int64)
        count = np.where(local < 0, 0, self.counts[local] if len(self.counts) else 0)
        lists: dict[int, np.ndarray] = {}
        for w in np.flatnonzero(np.minimum.reduceat(count[windows.flat], windows.starts)).tolist():
            terms = windows.numbers[w]
            order = np.argsort(count[terms], kind="stable").tolist()
            got = None
            for k in order:
                t = int(terms[k])
                if t not in lists:
                    lists[t] = self.places(int(local[t]))
                p = lists[t]
                if got is None:
                    got = p - k
                    got = got[got >= 0]
                else:
                    near = np.searchsorted(p, got + k)
                    near[near == len(p)] = 0
                    got = got[p[near] == got + k]
                if not len(got):
                    break
            got = self._inside(got, got + len(terms))
            close = self._close(terms, lists, local, slop) if slop is not None else got[:0]
            if len(got) or len(close):
                yield w, got, close

    def _inside(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Those that start and end within one document."""
        doc = np.searchsorted(self.starts, first, "right")
        return first[end <= self.starts[np.minimum(doc, len(self.starts) - 1)]]

    def _close(self, terms: np.ndarray, lists: dict, local: np.ndarray, slop: int) -> np.ndarray:
        def places(t: int) -> np.ndarray:
            if t not in lists:
                lists[t] = self.places(int(local[t]))
            return lists[t]

        anchor = places(int(terms[0]))
        doc = np.searchsorted(self.starts, anchor, "right")
        least, most = self.starts[doc - 1], self.starts[np.minimum(doc, len(self.starts) - 1)]
        good = np.ones(len(anchor), bool)
        for k in range(1, len(terms)):
            p = places(int(terms[k]))
            a = np.searchsorted(p, np.maximum(anchor + k - slop, least))
            b = np.searchsorted(p, np.minimum(anchor + k + slop + 1, most))
            good &= b > a
        return anchor[good]

    def documents(self, places: np.ndarray) -> np.ndarray:
        """The number in the block of the document at each place."""
        return np.searchsorted(self.starts, places, "right") - 1


def _parts(benchmark: DataFrame, most_words: int) -> Iterator[list[tuple[str, bytes]]]:
    part, words = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        text = (r["text"] or "").encode()
        part.append((r["i"] or "", text))
        words += len(text) // 4 + 1
        if words >= most_words:
            yield part
            part, words = [], 0
    if part:
        yield part


def search(index: DataFrame, benchmark: DataFrame, slop: int | None = None, window: int = WINDOW,
           part_words: int = PART_WORDS) -> DataFrame:
    """(id, n_words, n_hit, items, n_near) for each indexed document: words inside occurrences of test windows, the items
    whose windows occur (as strings, sorted) and, with ``slop``, the number of distinct windows' proximity matches in it."""
    def matcher(windows: Windows):
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    block = Block(row["sizes"], row["terms"], row["counts"], row["low"], row["high"])
                    edge = np.zeros(int(block.starts[-1]) + 1, np.int32)
                    items, near = defaultdict(set), np.zeros(len(row["ids"]), np.int64)
                    for w, first, close in block.search(windows, slop):
                        np.add.at(near, block.documents(close), 1)
                        if len(first):
                            np.add.at(edge, first, 1)
                            np.add.at(edge, first + windows.sizes[w], -1)
                            for d in np.unique(block.documents(first)).tolist():
                                items[d].update(windows.items[w])
                    hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    doc = np.searchsorted(block.starts, hit, "right") - 1
                    cuts = np.searchsorted(doc, np.arange(len(row["ids"]) + 1))
                    places = [(hit[a:b] - block.starts[d]).tolist() for d, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                    yield pa.record_batch(
                        [pa.array(row["ids"], pa.int64()), pa.array(row["sizes"], pa.int64()),
                         pa.array(places, pa.list_(pa.int64())),
                         pa.array([sorted(items.get(d, ())) for d in range(len(places))], pa.list_(pa.string())),
                         pa.array(near, pa.int64()),
                         pa.array([row["block"]] * len(places), pa.string()), pa.array(range(len(places)), pa.int64())],
                        ["id", "n_words", "places", "items", "n_near", "block", "at"])
        return match

    named = index.withColumn("block", F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index")))
    shape = "id long, n_words long, places array<long>, items array<string>, n_near long, block string, at long"
    parts = _parts(benchmark, part_words)
    part, more = next(parts, []), next(parts, None)
    all_ = named.mapInArrow(matcher(Windows(part, window)), shape)
    if more is not None:
        all_ = cut(all_, "hits")
        while more is not None:
            found = named.mapInArrow(matcher(Windows(more, window)), shape).filter("size(places) > 0 or n_near > 0")
            all_ = all_.unionByName(cut(found, "hits"))
            more = next(parts, None)
        all_ = all_.groupBy("block", "at").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.sum("n_near").alias("n_near"),
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return all_.select("id", "n_words", F.size("places").cast("long").alias("n_hit"), "items", "n_near")


def matches(index: DataFrame, benchmark: DataFrame, slop: int | None = None, window: int = WINDOW,
            part_words: int = PART_WORDS) -> DataFrame:
    """(id, item, window, place, kind) for each match of a test window in an indexed document: ``window`` is the window's
    first word in the item, ``place`` the first word of an exact match or the anchor of a proximity match in the document.
    Rows of the index with equal ids are not told apart; an exact match is a proximity match too."""
    def matcher(windows: Windows):
        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    block = Block(row["sizes"], row["terms"], row["counts"], row["low"], row["high"])
                    for w, first, close in block.search(windows, slop):
                        for kind, at in (("exact", first), ("near", close)):
                            doc = block.documents(at)
                            ids = [row["ids"][d] for d in doc.tolist()]
                            for item, start in windows.places[w] if len(at) else ():
                                yield pa.record_batch(
                                    [pa.array(ids, pa.int64()), pa.array([item] * len(at), pa.string()),
                                     pa.array([start] * len(at), pa.int64()), pa.array(at - block.starts[doc], pa.int64()),
                                     pa.array([kind] * len(at), pa.string())], ["id", "item", "window", "place", "kind"])
        return match

    shape = "id long, item string, window long, place long, kind string"
    all_ = None
    for part in _parts(benchmark, part_words):
        found = cut(index.mapInArrow(matcher(Windows(part, window)), shape), "matches")
        all_ = found if all_ is None else all_.unionByName(found)
    return index.mapInArrow(matcher(Windows([], window)), shape) if all_ is None else all_.distinct()


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words is inside test windows."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are.  Rows are known by a hash of id and text,
    so rows without an id, or with the same id and other texts, are judged one by one."""
    mark = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")
    index = build_index(docs.select(mark.alias("mark"), "text"), "mark")
    name = free_name(docs, "_llm_mark")  # columns of any name pass through
    bad = cut(search(index, benchmark).filter(contaminated()).select(F.col("id").alias(name)).distinct(), "contaminated")
    return docs.withColumn(name, mark).join(bad, name, "left_anti").select(*docs.columns)


def op6_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        contaminated().alias("contaminated"))
