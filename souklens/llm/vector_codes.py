"""Product codes of vectors, with nearest entries found by equal-average search (operator 13).

Each vector of integers ``floor(4096 * x)`` is cut into 8 equal parts; each part position has a codebook of 16 entries, and a
vector's code is the index of the nearest entry of each position.

The search for a part's nearest entry sorts the entries by the sum of their components.  By Cauchy-Schwarz two parts of d
components whose sums differ by g lie at a squared distance of g * g / d at least.  So the search starts where the part's own
sum falls and goes outward, one entry down and one entry up at a time; a direction ends as soon as g * g > d * best, strictly,
since an entry at exactly the best distance may still win by its lower index.  All of it in 64-bit integers.

The vectors lie in the shared folder once, as integers; each of the 6 rounds reads them, assigns, and sends one partial sum per
(task, position, entry) to the aggregate.  What the driver holds is the codebooks: parts * entries * d numbers, whatever the
size of the table.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped.  The codebooks start from the
kept rows with the smallest vec_id (rows without vec_id last, equal vec_ids by their components); with fewer than 16 rows the
codebooks have as many entries.  Vectors of another length than the first of these, and all if that length doesn't divide into
the parts, can't be cut as they are: their rows are returned with null code and error and count in no sum.  An empty vector
has parts without components, all at distance 0 of entry 0.  Repeated rows count one by one.  Components whose distances could
pass 64 bits raise an OverflowError.  Rows without label share one label_error.  An empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.llm.storage import bound_batches, cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SALT = 32  # shares of a label in the join with its total


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``entries`` (ties: the lowest) and its squared distance, for each row of ``vectors``."""
    d = vectors.shape[1]
    totals, own = entries.sum(1), vectors.sum(1)
    order = np.argsort(totals, kind="stable")
    totals = totals[order]
    above = np.searchsorted(totals, own)
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    index = np.zeros(len(vectors), np.int64)
    rows = {1: np.arange(len(vectors)), -1: np.arange(len(vectors))}
    for step in range(len(entries)):
        for way in (1, -1):
            at = rows[way]
            place = above[at] + step if way == 1 else above[at] - 1 - step
            inside = (place >= 0) & (place < len(entries))
            at, place = at[inside], place[inside]
            gap = own[at] - totals[place]
            near = (best[at] == np.iinfo(np.int64).max) | (gap * gap <= d * np.minimum(best[at], np.iinfo(np.int64).max // max(d, 1)))
            at, place = at[near], place[near]
            entry = order[place]
            off = ((vectors[at] - entries[entry]) ** 2).sum(1)
            better = (off < best[at]) | ((off == best[at]) & (entry < index[at]))
            best[at[better]], index[at[better]] = off[better], entry[better]
            rows[way] = at
        if not len(rows[1]) and not len(rows[-1]):
            break
    return index, best


def _ready(vectors: DataFrame, scale: int) -> DataFrame:
    """Kept rows with their integers, written once."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select("vec_id", "label", v.alias("embedding")).filter(F.col("embedding").isNotNull() & good)
    return cut(rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))).alias("x")), "code-vectors")


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``dim`` components, and the matrix of those."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = np.diff(column.offsets.to_numpy())
    first = np.cumsum(sizes) - sizes
    which = np.flatnonzero(sizes == dim)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat[first[which][:, None] + np.arange(dim)] if dim else np.zeros((len(which), 0), np.int64)
    if x.size and max(int(x.max()), -int(x.min())) >= (1 << 30) // max(dim, 1):
        raise OverflowError("components are too large for squared distances of 64 bits")
    return which, x


def _book(books: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and distances, a column for each part; ``books`` is (parts, entries, components)."""
    parts, _, d = books.shape
    both = [nearest(np.ascontiguousarray(matrix[:, p * d:(p + 1) * d]), books[p]) for p in range(parts)]
    return np.stack([i for i, _ in both], 1), np.stack([e for _, e in both], 1)


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks (parts, entries, components) of ``rows(vec_id, x)``; None where no row can be cut into the parts."""
    first = [r["x"] for r in rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    dim = len(first[0]) if first else 0
    if not first or dim % parts:
        return None
    first = [x for x in first if len(x) == dim]
    books = np.array(first, np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()

    def sums(now: np.ndarray):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.shape, np.int64), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                _, x = _matrix(batch, "x", dim)
                index, _ = _book(now, x)
                for p in range(parts):
                    np.add.at(total[p], index[:, p], x[:, p * now.shape[2]:(p + 1) * now.shape[2]])
                    count[p] += np.bincount(index[:, p], minlength=now.shape[1])
            p, e = np.nonzero(count)
            yield pa.record_batch([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]),
                                   pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])
        return add

    for _ in range(rounds):
        d = dim // parts
        moved = (rows.select("x").mapInArrow(sums(books), "part int, entry int, n long, total array<long>")
                 .groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(d))))
        for r in moved.collect():  # parts * entries rows
            books[r["part"], r["entry"]] = [int(r[f"t{k}"]) // r["n"] for k in range(d)]
    return books


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
           salt: int = SALT) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of ``vectors(vec_id, embedding, label)``."""
    rows = _ready(vectors, scale)
    books = train(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode() if books is not None else b"").hexdigest()
    dim = None if books is None else books.shape[0] * books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            if books is not None:
                which, x = _matrix(batch, "x", dim)
                index, off = _book(books, x)
                code[which] = [r.tobytes().hex() for r in index.astype(np.uint8)]
                error[which] = off.sum(1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                                  ["vec_id", "label", "code", "error"])

    kind = dict(rows.dtypes)
    coded = cut(rows.mapInArrow(assign, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"), "codes")
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"))
    totals = (coded.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))))
    share = F.pmod(F.xxhash64("vec_id", "code"), F.lit(salt)).cast("int")
    return (coded.withColumn("key", key).withColumn("salt", share).join(totals, ["key", "salt"])
            .select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def op13_equal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")
