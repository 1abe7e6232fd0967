"""Exact top-k search by distributed histogram selection (operator 11).

Scores are integer inner products of vectors whose components are ``floor(256 * x)``.  No list of scores is ever kept: the
place of each query's k-th best score is found by counting.

1. Vectors are packed where they lie into slices (one row each, 16,384 vectors), queries into blocks (1,024 queries).  Slices
   meet blocks on a grid: a slice goes to every column of blocks, a block to every row of slices, and each meeting is one
   joined row that a task scores with one integer matrix product, so a task holds one slice and one block however many
   there are.  The query set is given; documents are never compared with each other.
2. Each query has a range that holds its k-th best score, at first everything that Cauchy-Schwarz allows.  Each meeting
   counts the scores in 512 bins of that range, from the best bin down to where the slice alone holds k; what lies below
   can't hold the k-th best.  The counts are summed by (query, bin), and the bin that holds the k-th becomes the new range.
3. A range is done as soon as 16 * k candidates at most lie in or above it.  Where a single score still holds more (ties
   of many equal vectors), the same counting goes on over the vec_ids of that score, smallest first, so ties are broken
   without gathering them.
4. One last pass emits what lies in or above the range, at most 16 * k rows a query, and ranks them.

Products are exact: single precision is used where all partial sums stay below 2^24, double below 2^53, else 64-bit integers;
sums that could pass 2^62 end the query with an OverflowError, as a score column of 64 bits can't hold them.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without vec_id, take no part, as
query or as candidate.  Vectors of different length aren't compared.  The query's own rows are those of its vec_id; a query
that stands in several rows is answered for each.  Repeated candidates count one by one.  A query without candidates has no
rows; empty tables give none.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souklens.llm.storage import bound_batches, cut

K, EVERY, SCALE = 5, 50, 256.0
SLICE, BLOCK = 16_384, 1_024
BINS, FEW = 512, 16
LANES, COLUMNS = 1_024, 16  # the grid at most: rows of slices, columns of query blocks
_CHUNK = 1 << 21         # scores that a task holds at once
_PACKED = "uid string, dim int, ids binary, codes binary, width int, norm double, low long, high long"
_STATE = np.dtype([("low", "<i8"), ("last", "<u8"), ("above", "<i8"), ("tied", "<i8"), ("by_id", "?"), ("open", "?")])


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))), F.lit(False))


def integers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    out = np.floor(values * scale)
    if len(out) and np.abs(out).max() >= 2.0 ** 62:
        raise OverflowError("components are too large for integer scores of 64 bits")
    return out.astype(np.int64)


def _pack(vectors: DataFrame, size: int, scale: float, name: str) -> DataFrame:
    """Vectors of one length, ``size`` at most, as one row; nothing is shuffled."""
    def row(dim: int, ids: list, codes: list, uid: str) -> pa.RecordBatch:
        i, c = np.concatenate(ids), np.concatenate(codes)
        width = 2 if np.abs(c).max() < 1 << 15 else 8
        norm = float(np.sqrt((c.astype(np.float64) ** 2).sum(1).max()))
        return pa.RecordBatch.from_pylist([{"uid": uid, "dim": dim, "ids": i.astype("<i8").tobytes(), "width": width, "norm": norm,
                                            "codes": c.astype(f"<i{width}").tobytes(), "low": int(i.min()), "high": int(i.max())}],
                                          pa.schema([("uid", pa.string()), ("dim", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()),
                                                     ("width", pa.int32()), ("norm", pa.float64()), ("low", pa.int64()), ("high", pa.int64())]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}
        held: dict[int, int] = {}
        made, place = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, place = batch.column(1), batch.column(2)[0].as_py()
            sizes = np.diff(lists.offsets.to_numpy())
            values = integers(lists.flatten().to_numpy(zero_copy_only=False), scale)
            ids, first = batch.column(0).to_numpy(), np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == dim)
                for at in range(0, len(of), size):
                    some = of[at:at + size]
                    if held.get(dim, 0) + len(some) > size or sum(held.values()) + len(some) > 4 * size:
                        for d in [dim] if held.get(dim) else list(waiting):
                            yield row(d, *waiting.pop(d), f"{place}-{made}")
                            made, held[d] = made + 1, 0
                    have = waiting.setdefault(dim, ([], []))
                    have[0].append(ids[some])
                    have[1].append(values[first[some][:, None] + np.arange(dim)])
                    held[dim] = held.get(dim, 0) + len(some)
        for dim in list(waiting):
            yield row(dim, *waiting.pop(dim), f"{place}-{made}")
            made += 1

    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), F.spark_partition_id().alias("place"))
    return cut(rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).mapInArrow(make, _PACKED), name)


def _scores(queries: np.ndarray, slice_codes: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products; every partial sum is at most ``bound`` in size."""
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (queries.astype(kind) @ slice_codes.astype(kind).T).astype(np.int64)


def _codes(row: dict, side: str) -> np.ndarray:
    return np.frombuffer(row[f"{side}codes"], f"<i{row[f'{side}width']}").reshape(-1, row["dim"])


def _meetings(batches: Iterator[pa.RecordBatch], wanted: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """(block number, queries of a chunk, their ids, their state, candidate ids, scores) of every joined row."""
    for batch in batches:
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            state = np.frombuffer(r["state"], _STATE)
            which = np.flatnonzero(wanted(state))
            q, c = _codes(r, "q_"), _codes(r, "c_")
            bound = r["q_norm"] * r["c_norm"] * (1 + 1e-9) + 1
            q_ids, c_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["c_ids"], "<i8")
            step = max(1, _CHUNK // max(1, len(c_ids)))
            for k in range(0, len(which), step):
                part = which[k:k + step]
                yield r["q_uid"], part, q_ids[part], state[part], c_ids, _scores(q[part], c, bound)


def _place(state: np.ndarray, ids: np.ndarray, scores: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query of the chunk, candidate, distance from the best end of the range) of all candidates within the ranges."""
    high = state["low"] + state["last"].astype(np.int64)
    by_id = state["by_id"]
    s_low, s_high = np.where(by_id, state["tied"], state["low"]), np.where(by_id, state["tied"], high)
    i, j = np.nonzero((scores >= s_low[:, None]) & (scores <= s_high[:, None]) & (ids[None, :] != own[:, None]))
    off = np.where(by_id[i], ids[j].astype(np.uint64) - state["low"][i].astype(np.uint64),
                   (s_high[i] - scores[i, j]).astype(np.uint64))  # differences modulo 2^64
    good = off <= state["last"][i]
    return i[good], j[good], off[good]


def _width(last: np.ndarray) -> np.ndarray:
    """Values in a bin of ranges of last + 1 values."""
    return last // np.uint64(BINS) + np.uint64(1)


def _histogram(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, part, own, state, ids, scores in _meetings(batches, lambda s: s["open"]):
            i, _, off = _place(state, ids, scores, own)
            cells = np.bincount(i * BINS + (off // _width(state["last"])[i]).astype(np.int64), minlength=len(part) * BINS).reshape(-1, BINS)
            before = np.cumsum(cells, 1) - cells
            q, b = np.nonzero((cells > 0) & (before < (k - state["above"])[:, None]))
            yield pa.record_batch([pa.array([uid] * len(q), pa.string()), pa.array(part[q].astype(np.int64)), pa.array(b.astype(np.int32)),
                                   pa.array(cells[q, b].astype(np.int64))], ["q_uid", "q", "bin", "n"])
    return count


def _refined(state: np.ndarray, q: np.ndarray, b: np.ndarray, n: np.ndarray, k: int, ids: tuple[int, int]) -> np.ndarray:
    """The ranges after the counts ``n`` of the bins ``b`` of the queries ``q``."""
    state = state.copy()
    order = np.lexsort((b, q))
    q, b, n = q[order], b[order], n[order]
    total = np.cumsum(n)
    first = np.searchsorted(q, np.arange(len(state)))
    base = np.where(first < len(q), total[np.minimum(first, len(q) - 1)] - n[np.minimum(first, len(q) - 1)], 0) if len(q) else 0 * first
    reach = total - base[q] if len(q) else total
    hit = np.flatnonzero((reach >= k - state["above"][q]) & (reach - n < k - state["above"][q]))
    found = np.zeros(len(state), bool)
    for at in hit.tolist():
        s, low = state[q[at]], int(state["low"][q[at]])
        found[q[at]] = True
        width, last = int(s["last"]) // BINS + 1, int(s["last"])
        skip = int(b[at]) * width
        s["above"] += reach[at] - n[at]
        rest = min(width - 1, last - skip)
        s["low"], s["last"] = (low + skip if s["by_id"] else low + last - skip - rest), rest
        if s["above"] + n[at] <= FEW * k:
            s["open"] = False
        elif rest == 0:
            if s["by_id"]:
                s["open"] = False
            else:
                s["by_id"], s["tied"], s["low"], s["last"] = True, s["low"], ids[0], ids[1] - ids[0]
        state[q[at]] = s
    state["open"] &= found  # fewer than k candidates: all of them count
    return state


def search(vectors: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE, slice_size: int = SLICE,
           block_size: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries(vec_id, embedding)`` the ``k`` rows of ``vectors(vec_id,
    embedding)`` with the highest integer scores, equal ones by ascending vec_id; rows of the query's vec_id are left out."""
    spark = vectors.sparkSession
    slices = _pack(vectors, slice_size, scale, "topk-slices")
    blocks = _pack(queries, block_size, scale, "topk-queries")
    top = slices.agg(F.max("norm").alias("norm"), F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n")).first()
    ids = (top["low"], top["high"])
    lanes, columns = min(max(1, top["n"]), LANES), min(max(1, blocks.count()), COLUMNS)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                state = np.zeros(len(r["ids"]) // 8, _STATE)
                bound = r["norm"] * (top["norm"] or 0) * (1 + 1e-9) + 1
                if bound >= 2.0 ** 62:
                    raise OverflowError("scores would not fit into 64 bits")
                state["low"], state["last"], state["open"] = -int(bound) - 1, 2 * int(bound) + 2, True
                yield pa.record_batch([pa.array([r["uid"]]), pa.array([state.tobytes()], pa.binary()), pa.array([True])], ["q_uid", "state", "open"])

    state = cut(blocks.select("uid", "ids", "norm").mapInArrow(start, "q_uid string, state binary, open boolean"), "topk-state")
    left = (slices.select(*(F.col(c).alias(f"c_{c}") for c in ("ids", "codes", "width", "norm")), "dim",
                          F.pmod(F.xxhash64("uid"), F.lit(lanes)).cast("int").alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column")))
    right = (blocks.select(*(F.col(c).alias(f"q_{c}") for c in ("uid", "ids", "codes", "width", "norm")), "dim")
             .withColumn("column", F.pmod(F.xxhash64("q_uid"), F.lit(columns)).cast("int")))

    def meet(now: DataFrame) -> DataFrame:
        asked = right.join(now.select("q_uid", "state"), "q_uid").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        return left.join(asked, ["dim", "lane", "column"])

    def refine(counts: pa.Table, states: pa.Table) -> pa.Table:
        old = np.frombuffer(states.column("state")[0].as_py(), _STATE)
        new = _refined(old, *(counts.column(c).to_numpy() for c in ("q", "bin", "n")), k, ids)
        return pa.table({"q_uid": states.column("q_uid"), "state": pa.array([new.tobytes()], pa.binary()), "open": [bool(new["open"].any())]})

    while state.filter("open").limit(1).count():
        counted = (meet(state.filter("open")).mapInArrow(_histogram(k), "q_uid string, q long, bin int, n long")
                   .groupBy("q_uid", "q", "bin").agg(F.sum("n").alias("n")))
        state = cut(counted.groupBy("q_uid").cogroup(state.groupBy("q_uid")).applyInArrow(
            lambda c, s: refine(c, s) if s.column("open")[0].as_py() else s, "q_uid string, state binary, open boolean"), "topk-state")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uid, part, own, s, c_ids, scores in _meetings(batches, lambda s: np.ones(len(s), bool)):
            least = np.where(s["by_id"], s["tied"], s["low"])[:, None]
            last_id = np.where(s["by_id"], s["low"] + s["last"].astype(np.int64), np.iinfo(np.int64).max)[:, None]
            i, j = np.nonzero(((scores > least) | ((scores == least) & (c_ids[None, :] <= last_id))) & (c_ids[None, :] != own[:, None]))
            order = np.lexsort((c_ids[j], -scores[i, j], i))  # rows alike in score and id: k of them are enough
            i, j = i[order], j[order]
            i, j = (a[np.arange(len(i)) - np.searchsorted(i, i) < max(k, FEW * k)] for a in (i, j))
            yield pa.record_batch([pa.array([uid] * len(i), pa.string()), pa.array(part[i].astype(np.int64)), pa.array(own[i]),
                                   pa.array(c_ids[j]), pa.array(scores[i, j])], ["q_uid", "q", "query_id", "vec_id", "score"])

    found = meet(state).mapInArrow(emit, "q_uid string, q long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_uid", "q").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op11_histogram_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
