"""Ranked lexical search by exact inner products over sparse ball trees (operator 12).

A document is a sparse vector: its component for a term with ``tf`` occurrences is ``(10^9 * tf) div (1000 * tf + 20 * m)``,
with m from its length and the corpus' mean; a query's component is the term's weight, so a score is an inner product.

``build_index`` gathers documents where they lie into blocks of some 2 million words (4,096 documents at most), one row each.
Within a block they are split at the median of the widest of 32 signed hash projections until 16 remain, which gives a tree with
eight children a node; documents lie in tree order, and each node's radii are stored: the largest distance of a member from the
centroid over all terms, and in each of 256 bands of terms.  ``search`` visits a block's nodes best first.  For a node with
centroid c and radius r, no member's score exceeds q*c + |q'| * r, where q' is the query on the terms that the node holds (other
terms add nothing to any member), nor, band by band, q*c + the sum of the weights of these terms times their band's radius; the
smaller of the two is the bound.  A subtree is left out only if it is below the k-th best score known; every document of the
leaves that remain is scored in integers.

Rounding is safe: centroid sums are integers, radii are computed with the rounding error of every sum added and rounded up,
and the bound itself is raised by a part in 10^9.  Bounds decide only what is looked at.

The k-th best score known comes from a first pass in which each block scores one leaf for each query; the merged k-th best is
a lower limit for all tasks of the second pass, which raise it by what they find.  Each task gives its own k best at most,
and these are merged in two steps by (query, share), so no list of a query grows with the number of tasks unsplit.

Queries are packed into parts of 2,000; each part is joined to all blocks as one row and searched on its own.  Terms are 64-bit
hashes in the index; a wrong score needs a query's term to share its hash with another word of the corpus.

Defined cases: null, empty and wordless texts hold no terms, count for nothing and are never found; items without terms have no
rows.  Rows are documents of their own where doc_ids repeat, and so are items; documents without doc_id are found like others
and come last among equal scores.  An empty corpus or no items give no rows.  Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souklens.llm.storage import bound_batches, cut
from souklens.llm.text import Interner, alnum_words, chunks

K = 50
BLOCK_WORDS, BLOCK_DOCS = 2_000_000, 4_096
LEAF, STEP = 16, 3       # documents in a leaf; halvings between a node and its children
PART_ITEMS = 2_000
SHARES = 64              # of a query's found rows in the first step of the merge
BANDS = 256              # of terms with a radius of their own
_DIMS = 32               # of the projections that documents are split by
_INDEX = "ids array<long>, sizes binary, starts binary, terms binary, numbers binary, counts binary, widths array<int>, n_docs long, n_words long"
_TREE = _INDEX + ", radii binary"


def _pack(values: np.ndarray) -> tuple[bytes, int]:
    """Unsigned integers in as few bytes as hold the largest, and their width."""
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return values.astype(f"<u{width}").tobytes(), width


def _row(ids: list, sizes: np.ndarray, starts: np.ndarray, terms: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> dict:
    (n, n_width), (c, c_width) = _pack(numbers), _pack(counts)
    return {"ids": ids, "sizes": sizes.astype("<i8").tobytes(), "starts": starts.astype("<i8").tobytes(), "terms": terms.astype("<u8").tobytes(),
            "numbers": n, "counts": c, "widths": [n_width, c_width], "n_docs": int((sizes > 0).sum()), "n_words": int(sizes.sum())}


_FIELDS = [("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("sizes", "starts", "terms", "numbers", "counts")),
           ("widths", pa.list_(pa.int32())), ("n_docs", pa.int64()), ("n_words", pa.int64())]


def _batch(row: dict) -> pa.RecordBatch:
    fields = _FIELDS + [("radii", pa.binary())] * ("radii" in row)
    return pa.record_batch([pa.array([row[name]], kind) for name, kind in fields], [name for name, _ in fields])


def _forward(batches: Iterator[pa.RecordBatch], block_words: int, block_docs: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents with the occurrences of each document's terms, in the order in which the documents come."""
    def flush() -> pa.RecordBatch:
        every = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        order = np.argsort(every)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        sizes = np.array([len(x) for x in numbers], np.int64)
        flat = rank[np.concatenate(numbers)] if len(words) else np.zeros(0, np.int64)
        key, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(words)) + flat, return_counts=True)
        doc, number = np.divmod(key, max(1, len(words)))
        return _batch(_row(ids, sizes, np.searchsorted(doc, np.arange(len(sizes) + 1)), every[order], number, counts))

    ids, words, numbers, total = [], Interner(), [], 0
    for part, texts in chunks(batches, "text", 1 << 20):
        for i, t in zip(part.column(0).to_pylist(), texts):
            w = alnum_words(t)
            if ids and (total + len(w) > block_words or len(ids) == block_docs):
                yield flush()
                ids, words, numbers, total = [], Interner(), [], 0
            ids.append(i)
            numbers.append(words.numbers(w))
            total += len(w)
    if ids:
        yield flush()


def cuts(n: int, leaf: int = LEAF) -> list[np.ndarray]:
    """Borders of the nodes among ``n`` documents in tree order, from the root's level to the leaves'."""
    depth = 0
    while n > leaf << depth:
        depth += 1
    borders, out = np.array([0, n]), []
    for d in range(depth + 1):
        if d == 0 or (depth - d) % STEP == 0:
            out.append(borders)
        middle = (borders[:-1] + borders[1:]) // 2
        borders = np.concatenate([np.stack([borders[:-1], middle], 1).ravel(), borders[-1:]])
    return out


class Block:
    """One stored block, open."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        n_width, c_width = row["widths"]
        self.ids = row["ids"]
        self.sizes, self.starts = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["starts"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.numbers = np.frombuffer(row["numbers"], f"<u{n_width}")
        self.counts = np.frombuffer(row["counts"], f"<u{c_width}")
        self.n_docs, self.n_words = n_docs, n_words

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), np.diff(self.starts))

    def values(self, docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * self.sizes * self.n_docs) // max(1, self.n_words)
        tf = counts.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])

    def tree(self, leaf: int = LEAF) -> dict:
        """The block's row with its documents in tree order, and the radii of all nodes, level by level."""
        docs = self.docs()
        v = self.values(docs, self.counts)
        place = (self.terms % np.uint64(_DIMS)).astype(np.int64)
        sign = np.where(self.terms >> np.uint64(63), 1.0, -1.0)
        sketch = np.bincount(docs * _DIMS + place[self.numbers], sign[self.numbers] * v, len(self.sizes) * _DIMS).reshape(-1, _DIMS)
        order = np.arange(len(self.sizes))
        levels = cuts(len(order), leaf)
        borders = levels[0]
        while len(borders) < len(levels[-1]):
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
                part = sketch[order[a:b]]
                order[a:b] = order[a:b][np.argsort(part[:, part.var(0).argmax()], kind="stable")]
            middle = (borders[:-1] + borders[1:]) // 2
            borders = np.concatenate([np.stack([borders[:-1], middle], 1).ravel(), borders[-1:]])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.argsort(rank[docs], kind="stable")
        docs, numbers, counts, v = rank[docs][by], self.numbers[by].astype(np.int64), self.counts[by], v[by].astype(np.float64)
        radii = self._radii(levels, docs, numbers, v)
        lengths = np.diff(self.starts)[order]
        return _row([self.ids[k] for k in order], self.sizes[order], np.concatenate([[0], np.cumsum(lengths)]), self.terms, numbers,
                    counts) | {"radii": radii.tobytes()}

    def bands(self) -> np.ndarray:
        """The band of each of the block's terms."""
        return ((self.terms >> np.uint64(40)) % np.uint64(BANDS)).astype(np.int64)

    def _radii(self, levels: list[np.ndarray], docs: np.ndarray, numbers: np.ndarray, v: np.ndarray) -> np.ndarray:
        """(nodes, 1 + BANDS): for each node, level by level, the radius over all terms and that in each band."""
        n, width = len(self.sizes), max(1, len(self.terms))
        band = self.bands()
        place = docs * BANDS + band[numbers]
        square = np.bincount(place, v * v, n * BANDS).reshape(n, BANDS)
        out, cell, node_of, sums = [], None, None, None
        for borders in reversed(levels):
            node = np.searchsorted(borders, np.arange(n), "right") - 1
            if cell is None:
                keys, cell = np.unique(node[docs] * width + numbers, return_inverse=True)
                sums = np.bincount(cell, v, len(keys))
            else:
                up = np.searchsorted(borders, below, "right") - 1  # this level's node of each node of the level below
                keys, at = np.unique(up[node_of] * width + term, return_inverse=True)
                sums, cell = np.bincount(at, sums, len(keys)), at[cell]
            node_of, term, below = keys // width, keys % width, borders[:-1]
            members = np.diff(borders).astype(np.float64)
            dot = np.bincount(place, v * sums[cell], n * BANDS).reshape(n, BANDS) / members[node][:, None]
            centre = (np.bincount(node_of * BANDS + band[term], sums * sums, len(members) * BANDS).reshape(-1, BANDS) / (members * members)[:, None])[node]
            # squared distances, each raised by more than the rounding of its sums
            far = np.maximum(square - 2 * dot + centre, 0) + (len(v) + len(keys) + 16) * 2.0 ** -52 * (square + 2 * dot + centre)
            far = np.sqrt(np.concatenate([far.sum(1, keepdims=True), far], 1)) * (1 + 1e-9)
            far = np.nextafter(far.astype(np.float32), np.float32(np.inf))
            out.append(np.maximum.reduceat(far, borders[:-1], axis=0))
        return np.concatenate(out[::-1])


class Part:
    """One part of the queries: the distinct terms of each, as places in a sorted list of all."""

    def __init__(self, row: dict):
        self.items = row["items"]
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.starts, self.places = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["places"], "<i8")
        if row.get("weights") is not None:
            self.weights = np.frombuffer(row["weights"], "<i8")
        self.floors = np.frombuffer(row["floors"], "<i8") if row.get("floors") is not None else np.ones(len(self.items), np.int64)


def _pack_part(table: pa.Table) -> pa.Table:
    texts = table.column("text").cast(pa.binary()).to_pylist()
    sets = [{xxhash.xxh3_64_intdigest(w) for w in alnum_words(t or b"")} for t in texts]
    lists = [np.array(sorted(s), np.uint64) for s in sets]
    terms = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    places = np.searchsorted(terms, np.concatenate(lists)) if lists else np.zeros(0, np.int64)
    return pa.table({"part": table.column("part").slice(0, 1), "items": pa.array([table.column("item").to_pylist()], pa.list_(pa.string())),
                     **{k: pa.array([x.tobytes()], pa.binary()) for k, x in (("terms", terms.astype("<u8")), ("starts", starts.astype("<i8")),
                                                                              ("places", places.astype("<i8")))}})


class Searcher:
    """The queries of a part within one block."""

    def __init__(self, block: Block, radii: np.ndarray, part: Part, leaf: int = LEAF):
        self.block, self.part = block, part
        at = np.searchsorted(part.terms, block.terms)
        known = (at < len(part.terms)) & (part.terms[np.minimum(at, max(0, len(part.terms) - 1))] == block.terms) if len(part.terms) else np.zeros(len(at), bool)
        of = np.where(known, at, -1)[block.numbers]
        kept = np.flatnonzero(of >= 0)
        docs = np.searchsorted(block.starts, kept, "right") - 1
        order = np.argsort(of[kept], kind="stable")  # term by term, documents ascending
        docs, kept = docs[order], kept[order]
        term = of[kept]
        values = block.values(docs, block.counts[kept])
        self.levels = cuts(len(block.sizes), leaf)
        self.radii = np.split(radii.reshape(-1, 1 + BANDS), np.cumsum([len(b) - 1 for b in self.levels])[:-1])
        self.bands = ((part.terms >> np.uint64(40)) % np.uint64(BANDS)).astype(np.int64)
        self.lists = []  # for each level, last the documents: (start of each term, node, sum)
        for borders in self.levels:
            node = np.searchsorted(borders, docs, "right") - 1
            new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (node[1:] != node[:-1])])) if len(term) else np.zeros(0, np.int64)
            sums = np.add.reduceat(values, new) if len(new) else values
            self.lists.append((np.searchsorted(term[new], np.arange(len(part.terms) + 1)), node[new], sums))
        self.lists.append((np.searchsorted(term, np.arange(len(part.terms) + 1)), docs, values))

    def cells(self, level: int, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nodes (ascending) that hold a term of the query, the weighted sums, the weights and the terms' bands there."""
        starts, node, sums = self.lists[level]
        a, n = starts[terms], starts[terms + 1] - starts[terms]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        node, w = node[at], np.repeat(weights, n)
        order = np.argsort(node, kind="stable")
        return node[order], (w * sums[at])[order], w[order], np.repeat(self.bands[terms], n)[order]

    def bounds(self, level: int, a: int, b: int, cells: tuple[np.ndarray, ...]) -> np.ndarray:
        """What no member of the nodes ``a`` to ``b`` of a level scores more than."""
        node, sums, w, band = cells
        x, y = np.searchsorted(node, (a, b))
        if x == y:
            return np.zeros(b - a)
        at, w, radii = node[x:y] - a, w[x:y].astype(np.float64), self.radii[level]
        inner = np.bincount(at, sums[x:y], b - a) / np.diff(self.levels[level][a:b + 1])
        whole = np.sqrt(np.bincount(at, w * w, b - a)) * radii[a:b, 0]
        banded = np.bincount(at, w * radii[node[x:y], 1 + band[x:y]], b - a)
        return np.where(inner > 0, (inner + np.minimum(whole, banded)) * (1 + 1e-9) + 1, 0)

    def run(self, q: int, floor: int, leaves: int | None, found) -> int:
        """Visits subtrees best first; ``found(places, scores)`` takes scores of at least the floor and gives the new one."""
        part = self.part
        terms = part.places[part.starts[q]:part.starts[q + 1]]
        weights = part.weights[terms]
        held = self.lists[-1][0]
        there = held[terms + 1] > held[terms]
        terms, weights = terms[there], weights[there]
        if not len(terms):
            return floor
        cells: list = [None] * len(self.lists)
        last = len(self.levels) - 1

        def bounds(level: int, a: int, b: int) -> np.ndarray:
            if cells[level] is None:
                cells[level] = self.cells(level, terms, weights)
            return self.bounds(level, a, b, cells[level])

        heap = [(-float(bounds(0, 0, 1)[0]), 0, 0)]
        scored = 0
        while heap and -heap[0][0] >= floor and scored != leaves:
            _, level, node = heapq.heappop(heap)
            if level == last:
                scored += 1
                if cells[-1] is None:
                    cells[-1] = self.cells(-1, terms, weights)
                docs, parts = cells[-1][:2]
                a, b = self.levels[last][node], self.levels[last][node + 1]
                x, y = np.searchsorted(docs, (a, b))
                scores = np.zeros(b - a, np.int64)
                if int(weights.sum()) * 1_000_000 < 1 << 53:
                    scores = np.bincount(docs[x:y] - a, parts[x:y], b - a).astype(np.int64)  # whole numbers below 2^53
                else:
                    np.add.at(scores, docs[x:y] - a, parts[x:y])
                good = np.flatnonzero(scores >= floor)
                if len(good):
                    floor = found(good + a, scores[good])
                continue
            borders = self.levels[level + 1]
            a, b = np.searchsorted(borders, (self.levels[level][node], self.levels[level][node + 1]))
            limit = bounds(level + 1, int(a), int(b))
            for k in np.flatnonzero(limit >= floor).tolist():
                heapq.heappush(heap, (-float(limit[k]), level + 1, int(a) + k))
        return floor


class _Best:
    """A query's k best of a task, by score, then doc_id (none last)."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.rows = k, floor, []

    def add(self, ids: list, scores: np.ndarray) -> int:
        self.rows += [(-s, i is None, i or 0) for i, s in zip(ids, scores.tolist())]
        if len(self.rows) >= self.k:
            self.rows = heapq.nsmallest(self.k, self.rows)
            self.floor = max(self.floor, -self.rows[-1][0])
        return self.floor


def build_index(docs: DataFrame, block_words: int = BLOCK_WORDS, block_docs: int = BLOCK_DOCS, leaf: int = LEAF) -> tuple[DataFrame, int, int]:
    """The index of ``docs(doc_id, text)``, the number of documents with terms, and of all their terms."""
    blocks = cut(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
                 .mapInArrow(lambda batches: _forward(batches, block_words, block_docs), _INDEX), "lexical-blocks")
    total = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("l")).first()
    n, words = total["n"] or 0, total["l"] or 0

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield _batch(Block(batch.slice(at, 1).to_pylist()[0], n, words).tree(leaf))

    return cut(blocks.filter("n_docs > 0").mapInArrow(grow, _TREE), "lexical-trees"), n, words


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query with their rank, in two steps."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    share = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SHARES))
    some = (found.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("part", "q", "share").orderBy(*best)))
            .filter(F.col("rank") <= k))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("part", "q").orderBy(*best))).filter(F.col("rank") <= k).drop("share")


def search(index: tuple[DataFrame, int, int], items: DataFrame, k: int = K, part_items: int = PART_ITEMS, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each row of ``items(item_id,
    text)``, equal scores by ascending doc_id."""
    trees, n, words = index
    spark = trees.sparkSession
    kind = dict(items.dtypes)["item_id"]
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    n_parts = max(1, -(-rows.count() // part_items))
    number = F.pmod(F.xxhash64("item", "text", F.monotonically_increasing_id()), F.lit(n_parts)).cast("int")
    packed = "part int, items array<string>, terms binary, starts binary, places binary"
    parts = cut(rows.withColumn("part", number).groupBy("part").applyInArrow(_pack_part, packed), "lexical-queries")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = part = None
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                if part is None:
                    part, total = r["part"], np.zeros(len(r["q_terms"]) // 8, np.int64)
                wanted, held = np.frombuffer(r["q_terms"], "<u8"), np.frombuffer(r["terms"], "<u8")
                docs = np.bincount(np.frombuffer(r["numbers"], f"<u{r['widths'][0]}"), minlength=len(held))
                at_ = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                total += np.where(held[at_] == wanted, docs[at_], 0)
        if part is not None:
            t = np.flatnonzero(total)
            yield pa.record_batch([pa.array([part] * len(t), pa.int32()), pa.array(t), pa.array(total[t])], ["part", "term", "df"])

    def weigh(one: pa.Table, df: pa.Table) -> pa.Table:
        count_of = np.zeros(len(one.column("terms")[0].as_py()) // 8, np.int64)
        count_of[df.column("term").to_numpy()] = df.column("df").to_numpy()
        w = np.floor(1000 * np.log((2 * n + 2) / (2 * count_of + 1))).astype("<i8")
        return one.append_column("weights", pa.array([w.tobytes()], pa.binary()))

    def raise_floors(one: pa.Table, known: pa.Table) -> pa.Table:
        floors = np.ones(len(one.column("items")[0].as_py()), "<i8")
        floors[known.column("q").to_numpy()] = known.column("score").to_numpy()
        return one.append_column("floors", pa.array([floors.tobytes()], pa.binary()))

    def visit(leaves: int | None):
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = best = number = None
            for batch in batches:
                for at in range(batch.num_rows):
                    r = batch.slice(at, 1).to_pylist()[0]
                    if part is None:
                        number = r["part"]
                        part = Part({name[2:]: value for name, value in r.items() if name.startswith("q_")})
                        best = [_Best(k, int(f)) for f in part.floors]
                    block = Block(r, n, words)
                    searcher = Searcher(block, np.frombuffer(r["radii"], "<f4"), part, leaf)
                    for q, b in enumerate(best):
                        searcher.run(q, b.floor, leaves, lambda places, scores: b.add([block.ids[p] for p in places.tolist()], scores))
            for q, b in enumerate(best or []):
                if b.rows:
                    yield pa.record_batch([pa.array([number] * len(b.rows), pa.int32()), pa.array([q] * len(b.rows), pa.int32()),
                                           pa.array([part.items[q]] * len(b.rows), pa.string()),
                                           pa.array([None if none else i for _, none, i in b.rows], pa.int64()), pa.array([-s for s, _, _ in b.rows], pa.int64())],
                                          ["part", "q", "item", "doc_id", "score"])
        return go

    def beside(queries: DataFrame) -> DataFrame:
        """Every block beside the one row of a part."""
        return trees.crossJoin(F.broadcast(queries.select("part", *(F.col(c).alias(f"q_{c}") for c in queries.columns if c != "part"))))

    shape, found = "part int, q int, item string, doc_id long, score long", None
    for p in range(n_parts):
        one = parts.filter(F.col("part") == p)
        df = beside(one).mapInArrow(count, "part int, term long, df long").groupBy("part", "term").agg(F.sum("df").alias("df"))
        one = cut(one.groupBy("part").cogroup(df.groupBy("part")).applyInArrow(weigh, packed + ", weights binary"), "lexical-weights")
        known = _merged(beside(one).mapInArrow(visit(1), shape), k).filter(F.col("rank") == k)
        one = cut(one.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(raise_floors, packed + ", weights binary, floors binary"), "lexical-floors")
        answer = _merged(beside(one).mapInArrow(visit(None), shape), k)
        if n_parts > 1:
            answer = cut(answer, "lexical-found")
        found = answer if found is None else found.union(answer)
    return found.select(F.col("item").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
